"""tagplace: Spark jobs that predict where a tagged photo was taken."""
