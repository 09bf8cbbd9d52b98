"""Text operators against brute force, exact round trips and held-out figures; odd inputs for each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagplace.llm import chat, decontaminate, exact_dedup, line_dedup, lm, near_dedup, packing, token_files, tokens, toxicity, url_filter
from tagplace.llm import queries as Q
from tagplace.llm.common import read

DOCS = "doc_id long, text string"
#: Odd columns that ride along and clash with names of results.
ODD = "doc_id long, text string, kept string, row string, set string, score string, N_words string"


def odd_docs(spark, texts):
    return spark.createDataFrame([(i, t, "k", "r", "s", None, "w") for i, t in texts], ODD)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# --- url filter ---------------------------------------------------------------------------------------------


def judge(rules, host, path):
    fit = [(len(h + p), h.count("."), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, "allow")


def test_url_filter_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.org", "x.a.org", "example.org", "m.example.org", "b.com", "org", "notexample.org", ""]
    urls = [rng.choice(["http://", "https://", "", "HTTP://"]) + rng.choice(hosts).swapcase() + "".join(rng.choice(["/es/", "/en/1", "/fr/", "/de/", "?q=/de/", "#/fr/", "/", "x"]) for _ in range(rng.randint(0, 3))) for _ in range(300)] + [None, "", "://", "http://?"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, Verdict string")
    rules = [*Q.RULES, ("com", "/fr/", "block"), ("b.com", "", "allow")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.UrlFilter.fit(table, pages).judge(pages).collect()}
    blocks = [r for r in rules if r[:2] != ("com", "/fr/")] + [("com", "/fr/", "block")]
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), raw)
        path = re.match(r"[^?#]*", rest[len(raw) :]).group()
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].rule, got[i].verdict) == judge(blocks, host, path), u
    joined = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_by_join(table, pages, "page_id").collect()}
    assert joined == {i: (r.rule, r.verdict) for i, r in got.items()}


def test_url_filter_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.UrlFilter.fit(none, pages).judge(pages).first().verdict == "allow"
    rules = spark.createDataFrame(Q.RULES, "host string, path string, verdict string")
    assert url_filter.UrlFilter.fit(rules, pages.limit(0)).judge(pages).first().rule == "org/"


def test_url_filter_beyond_the_bounds(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://m.example.org/es/x"), (2, "http://a.com/de/"), (2, "http://a.com/de/"), (3, None), (4, "http://a.com/" + "x" * 3000)], "page_id long, url string")
    rules = spark.createDataFrame(Q.RULES, "host string, path string, verdict string")
    rows = lambda: sorted(map(str, url_filter.judge_urls(rules, pages).collect()))
    usual = rows()
    monkeypatch.setattr(url_filter, "MAX_SHAPES", 1)
    assert rows() == usual and len(usual) == 5


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("crc32(cast(key as binary)) % 7 = 0")
    c = url_filter.Cascade.build(listed, universe, 3)
    assert len(c.levels) > 1
    wrong = universe.join(listed.withColumn("is", F.lit(True)), "key", "left").where(F.coalesce("is", F.lit(False)) != c.has(F.col("key")))
    assert wrong.count() == 0


# --- tokens -------------------------------------------------------------------------------------------------


def test_pieces_equal_library():
    rng = random.Random(2)
    made = ["", " ", "a\n b", "\n \nx", "<|endoftext|> a <|endoftext|>b", "x \n", "é ü  b c　d", "word " * 3000, "a.. b!? c-", "x" * 200_000]
    made += ["".join(rng.choice([" ", " ", "\n", "a", "Bc", "é", "1", "'s", ".", "\xa0", "\t", "<|endoftext|>", "\x1f", "²", "日"]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    made += ["".join(rng.choice([" ", " a", " Bc", " é1", "'s", ".", "!", " ²", " 日", "-"]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    e = tokens.PieceEncoder(tokens.default_tokenizer(), max_words=60)
    for at in range(0, len(made), 500):
        own = made[at : at + 500]
        ids, counts = e.encode(pa.array(own, pa.string()))
        ends = np.cumsum(counts)
        for t, a, b in zip(own, ends - counts, ends, strict=True):
            assert ids[a:b].tobytes() == e.plain(t), repr(t)
    ids, counts = e.encode(pa.array([None, "", "a"], pa.string()))
    assert counts.tolist() == [0, 0, 1] and len(ids) == 1


def test_new_words_are_encoded_some_at_a_time():
    class Spy:
        def __init__(self, tok):
            self.tok, self.longest = tok, 0

        def encode_batch_fast(self, texts, **options):
            self.longest = max(self.longest, sum(map(len, texts)))
            return self.tok.encode_batch_fast(texts, **options)

    e = tokens.PieceEncoder(tokens.default_tokenizer())
    text = " ".join(f"w{i}" for i in range(40_000))
    e.tok = spy = Spy(e.tok)
    ids, counts = e.encode(pa.array([text], pa.string()))
    assert spy.longest < 20_000  # the library takes memory for each character
    assert ids.tobytes() == np.array(spy.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes() and counts.tolist() == [len(ids)]


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 241, 3000):
        for top in (1, 2, 300, 50257, 2**59, 2**63):
            v = rng.integers(0, top, n, dtype=np.uint64)
            if n > 100:
                v[rng.integers(0, n, 4)] = np.uint64(2**64 - 1)
            assert (token_files.unpack(*token_files.pack(v), n) == v).all()
    ids, counts, values = [5, None, 7], [70_000, 1, 4], rng.integers(0, 50257, 70_005).astype(np.uint32)
    a, b, c = token_files.unpack_block(token_files.pack_block(ids, counts, values))
    assert a == ids and b.tolist() == counts and (c == values).all()


def test_token_files(spark, docs, texts):
    e = tokens.PieceEncoder(tokens.default_tokenizer())
    at = 0
    for r in sorted(token_files.token_index(docs).collect()):
        ids = [*e.tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_odd(spark, tmp_path):
    odd = odd_docs(spark, [(2, None), (None, "b"), (2, ""), (1, "x " * 50_000)])
    token_files.write_tokens(odd, f"{tmp_path}/t")
    got = token_files.read_tokens(spark, f"{tmp_path}/t", with_ids=True).collect()
    long = [*tokens.PieceEncoder(tokens.default_tokenizer()).tok.encode("x " * 50_000, add_special_tokens=False).ids, 0]
    got = sorted(got, key=lambda r: (r.start, r.n_tokens))
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 2), (1, len(long)), (2, 1), (2, 1)] and list(got[1].ids) == long
    token_files.write_tokens(odd.limit(0), f"{tmp_path}/e")
    assert token_files.read_tokens(spark, f"{tmp_path}/e").count() == 0


# --- packing ------------------------------------------------------------------------------------------------


def least_bins(items, cap):
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= items[i]:
                go(i + 1, [*bins[:j], bins[j] - items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, cap - items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_when_small():
    rng = random.Random(3)
    for _ in range(80):
        cap = rng.choice([10, 20, 50])
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 8))]
        got = packing.complete_bins(Counter(items), cap)
        assert Counter(x for f, n in got for x in f * n) == Counter(items) and all(sum(f) <= cap for f, _ in got)
        assert sum(n for _, n in got) == least_bins(items, cap)


def test_pack(spark, docs, texts):
    got = packing.pack(docs, with_ids=True).collect()
    tok = tokens.PieceEncoder(tokens.default_tokenizer()).tok
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, t in texts.items():
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and all(r.length == 1024 for r in own[1:])
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    hist = Counter(r.length for r in got)
    assert len(by_seq) <= packing.lower_bound(hist, 1024) * 1.005 + 1
    assert packing.pack(odd_docs(spark, [(1, None), (None, "a")]), 8).count() == 2
    assert packing.pack(docs.limit(0)).count() == 0
    again = packing.pack(odd_docs(spark, [(1, "x " * 3000), (1, "x " * 3000), (1, None)]), 100).collect()
    assert len({(r.sequence_id, r.offset) for r in again}) == len(again) and sum(r.length == 1 for r in again) == 1


# --- chat and lines -----------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", None), (5, 0, None, ""), (None, 0, "user", "z"), (6, 0, "user", "c"), (6, 0, "user", "c")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, chat string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.chat) for r in chat.render(turns).collect()}
    assert set(got) == {2, 4, 5, None, 6}
    assert got[2] == (2, 2, "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n") and got[6][0] == 2
    assert chat.render(turns.limit(0)).count() == 0


def test_lines_near_the_threshold_hot_and_repeated(spark):
    rows = [(i, "hot\n" + f"l{i % 7}", f"s{i % 12}") for i in range(200)] * 2 + [(500, "long " * 40_000 + "\nhot", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sites = {}
    for _, t, s in rows:
        for line in t.split("\n"):
            sites.setdefault(line.strip(), set()).add(s)
    for least in (2, 11, 12, 13):
        got = line_dedup.drop_boilerplate(df, sites=least).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.n_removed == sum(len(sites[x.strip()]) >= least for x in r.text.split("\n"))


def test_lines(spark):
    rows = [(i, f"own {i}\n common \n\nsome {i % 3}", f"s{i}") for i in range(12)] + [(20, None, "s1"), (21, "", None), (22, "common", None)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, source string, N_LINES string")
    got = {r.doc_id: (r.clean_text, r.n_lines, r.n_removed) for r in line_dedup.drop_boilerplate(df, sites=13).collect()}
    assert got[3] == ("own 3\n\nsome 0", 3, 1) and got[20] == (None, 0, 0) and got[21] == ("", 0, 0) and got[22] == ("", 1, 1)
    assert all(r.n_removed == 0 for r in line_dedup.drop_boilerplate(df, sites=14).collect())
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


# --- duplicates ---------------------------------------------------------------------------------------------


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, span in ((0, 10), (1, 2**60), (500, 2**50), (300, 301)):
        v = np.sort(rng.choice(span, n, replace=False) if span < 10**6 else np.unique(rng.integers(0, span, n))).astype(np.uint64)
        assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(v, span)) == v).all()


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_exact_dedup(spark, bound, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BITMAPS", bound)  # broadcast, then joined by shuffle
    monkeypatch.setattr(exact_dedup, "MAX_GROUPS", bound)
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "", None, "c " * 2000, f"u{i}"])) for i in range(400)] + [(3, "a"), (None, "a"), (None, "only"), (None, "only"), (999, "b"), (999, "b")]
    df = odd_docs(spark, rows).repartition(7)
    got = exact_dedup.mark_duplicates(df).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows) and "k" not in {r.kept for r in got}
    for r in got:
        own = groups[r.text or ""]
        assert r.group_size == len(own) and r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.keep_id == max((x for x in own if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.mark_duplicates(df.limit(0)).count() == 0


def test_exact_dedup_when_written_parts_are_read_in_pieces(spark):
    rows = [(i, hashlib.sha512(str(i % 3000).encode()).hexdigest() * 2) for i in range(6000)]
    small = {"parquet.block.size": "20000", "spark.sql.files.maxPartitionBytes": "30000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = exact_dedup.mark_duplicates(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == len(rows) and sum(r.kept for r in got) == 3000
    assert all(r.group_size == 2 and r.keep_id == r.doc_id % 3000 + 3000 for r in got)


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = {}
    for i, (doc, _) in enumerate(rows):
        out.setdefault(find(i), []).append(doc)
    return {doc: min(c) for c in out.values() for doc in c}, {doc: len(s) for (doc, _), s in zip(rows, sets, strict=True)}


def near_rows():
    """Copies edited once or often, chains of edits, and texts that share a passage."""
    rng, rows = random.Random(6), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    for base in range(6):
        text = [word() for _ in range(120)]
        for _ in range(30 if base == 0 else 8):
            own = list(text)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(120)] = word()
            rows.append(" ".join(own))
        for _ in range(8):  # a chain
            text[rng.randrange(120)] = word()
            rows.append(" ".join(text))
    shared = " ".join(word() for _ in range(60))
    rows += [shared + " " + " ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(40)]
    rows += ["", None, "  \n", "one two", "ONE two", "one two three", "a b c d e", "a b c d f"]
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = near_rows()
    random.Random(1).shuffle(rows)
    comps, sizes = brute_components(rows, percent)
    got = near_dedup.near_duplicates(odd_docs(spark, rows).repartition(5), percent).collect()
    assert {r.doc_id: r.component_id for r in got} == comps
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = near_dedup.drop_near_duplicates(odd_docs(spark, rows), percent)
    assert left.columns == odd_docs(spark, rows).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(comps.values()))


def test_scratch_keeps_what_is_read(spark):
    from tagplace.llm.common import Scratch, written

    with Scratch() as scratch:
        a, b = written(spark.range(3).toDF("x"), "a"), written(spark.range(4).toDF("x"), "b")
    written(spark.range(1).toDF("x"), "c")
    assert len(scratch.paths) == 2
    scratch.clear(b)
    assert b.count() == 4 and scratch.paths == [b._written_to]
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        a.count()


def test_near_dedup_odd(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MAX_IDS", -1)  # every side by shuffle
    df = odd_docs(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "zz")])
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got if r.n_shingles == 2) == [("4", 4, False), ("4", 4, True), ("None", 4, False)]
    assert near_dedup.drop_near_duplicates(df).count() == 2
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_dedup_long_text_and_repeats(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-100])), (3, " ".join(words[:30_000])), (1, " ".join(words))]
    got = near_dedup.near_duplicates(odd_docs(spark, rows), 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, False), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_near_dedup_finds_all_links_of_made_pairs(spark):
    rng, rows, linked = random.Random(12), [], set()
    for i in range(400):  # pairs from 6 to 200 words, at and above the threshold
        w = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(rng.choice([6, 9, 12, 20, 40, 200]))]
        other = list(w)
        for _ in range(rng.randint(0, max(1, len(w) // 40))):
            other[rng.choice([0, len(w) - 1, rng.randrange(len(w))])] = "zz"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        if 100 * len(a & b) >= 80 * len(a | b):
            linked.add(2 * i + 1)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 80).collect()
    assert len(linked) > 150 and {r.doc_id for r in got if r.component_id != r.doc_id} == linked


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in near_dedup.components(edges).collect()}
    assert {got[i] for i in range(51)} == {0} and got[101] == 100


# --- decontamination ----------------------------------------------------------------------------------------


def brute_hits(text, items, width=10):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hit, found = words_of(text), set(), set()
    for name, t in items:
        w = words_of(t)
        for i in range(max(1, len(w) - width + 1)) if w else []:
            own = w[i : i + width]
            for j in range(len(words) - len(own) + 1):
                if words[j : j + len(own)] == own:
                    hit |= set(range(j, j + len(own)))
                    found.add(str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: rng.choice(["ab", "cd", "Été", "x1", "zz", "q"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 3, 9, 10, 11, 14])))) for i in range(12)] + [(12, None), (3, "ab cd ab cd ab zz q")]
    rows = [(0, None)]
    for i in range(1, 60):
        text = " ".join(word() + rng.choice(["", ",", "-"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text + rng.choice(["", " ", "! ", "\n"]) + (rng.choice(items)[1] or "") * rng.randint(0, 1)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = odd_docs(spark, rows)
    for bound in (1 << 20, 900):  # one automaton, then several
        monkeypatch.setattr(decontaminate, "MAX_WINDOW_BYTES", bound)
        for r in decontaminate.contamination(df, bench).collect():
            text = dict(rows)[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_hits(text, [x for x in items if x[1]])
            assert r.contaminated == (r.n_hit > 0)
            inside = [len(decontaminate.words_of(text[s.start : s.end])) for s in r.spans]
            assert sum(inside) == r.n_hit
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


# --- models -------------------------------------------------------------------------------------------------


def test_lm_counts_and_base(spark, docs, texts):
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    words_of = lambda t: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)), ""]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in words_of(t))
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        w = words_of(t)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert got[i].score < 0


def test_lm_vocabulary_follows_the_counts(spark, monkeypatch):
    outputs = []
    monkeypatch.setattr(lm, "make_classes", lambda counts, classes, made=lm.make_classes: outputs.append(len(counts)) or made(counts, classes))
    rows = [(i, " ".join(f"w{(i * 97 + j) % 3000}" for j in range(200)) + f" once{i}") for i in range(600)]
    got = lm.score_texts(spark.createDataFrame(rows, DOCS)).collect()
    # 3,000 frequent words, "rare" and the end
    assert outputs == [3002] and len(got) == 600 and all(r.score < 0 for r in got)


def test_lm_classes_hold_all_words_evenly():
    counts = np.concatenate([[5e6, 1e6], 1e6 / np.arange(1, 20_001)])
    sizes = np.bincount(lm.make_classes(counts, 142), minlength=142)
    assert sizes.sum() == len(counts) and sizes.max() <= 2 * -(-len(counts) // 142)


def test_lm_beats_counts_where_order_matters(spark):
    rng = random.Random(1)
    nxt = {w: rng.sample("abcdefghijklmnop", 2) for w in "abcdefghijklmnop"}

    def text():
        w = [rng.choice("abcdefghijklmnop")]
        for _ in range(200):
            w.append(rng.choice(nxt[w[-1]]))
        return " ".join(w)

    df = spark.createDataFrame([(i, text()) for i in range(400)], DOCS)
    s = lm.score_texts(df).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > 0.9 * s[1]


def test_lm_is_normalised():
    counts = np.array([50.0, 5, 40, 30, 20, 10, 5, 1])
    cls_of = lm.make_classes(counts, 3)
    p = lm.Params.start(counts, cls_of, 3)
    scorer = lm.Scorer(p, cls_of)
    total = sum(np.exp(scorer.log_probs(np.array([3, 4, w]))[2]) for w in range(8))
    assert math.isclose(total, 1, rel_tol=1e-5)


def test_lm_beats_counts_on_held_out_rows(spark, sf):
    got = lm.score_texts(read(spark, sf.replace("sf0.001", "sf0.01"), "documents"))
    s = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


def test_lm_scores_in_exact_single_precision():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 400).astype(float)
    cls_of = lm.make_classes(counts, 20)
    scorer = lm.Scorer(lm.Params.start(counts, cls_of, 20), cls_of)
    assert scorer.top.dtype == np.float32 and not scorer.large
    h = np.hstack([scorer.r1 + scorer.r2[::-1], np.ones((400, 1), np.float32)])
    for q in [scorer.top, *scorer.within]:
        assert (h @ q == h.astype(np.float64) @ q.astype(np.float64)).all()
        assert (h @ q == h[:, ::-1] @ q[::-1]).all() and (h[7:8] @ q == (h @ q)[7:8]).all()
    index, values = rng.integers(0, 50, 300), rng.standard_normal((300, 3)).astype(np.float32)
    rows, sums = lm._spread(index, values)
    assert rows.tolist() == np.unique(index).tolist() and np.allclose(sums, [values[index == i].sum(0) for i in rows], atol=1e-5)
    p = lm.Params.start(counts, cls_of, 20)
    p.q *= 1000
    large = lm.Scorer(p, cls_of)
    assert large.large and large.top.dtype == np.float64 and np.isfinite(large.log_probs(np.array([5, 6, 1]))).all()


def test_lm_contexts_are_summed_once_and_words_alone_in_a_class_are_certain(monkeypatch):
    rng = np.random.default_rng(2)
    # word 0 is alone in its class
    counts = np.concatenate([[5000.0, 100], rng.integers(1, 60, 200)])
    cls_of = lm.make_classes(counts, 15)
    assert (cls_of == cls_of[0]).sum() == 1
    p = lm.Params.start(counts, cls_of, 15)
    scorer, asked = lm.Scorer(p, cls_of), []
    ids = np.concatenate([np.where(rng.random(3000) < 0.6, 0, rng.integers(2, 202, 3000)), [lm.STOP]])
    monkeypatch.setattr(lm.Scorer, "_log_sum", lambda self, h, q, made=lm.Scorer._log_sum: asked.append((len(h), q.shape[1])) or made(self, h, q))
    got = scorer.log_probs(ids)
    u, v = np.concatenate([[1], ids[:-1]]), np.where(np.concatenate([[1], ids[:-1]]) == 1, 1, np.concatenate([[1, 1], ids[:-2]])[: len(ids)])
    assert asked[0] == (len(set(zip(u.tolist(), v.tolist()))), 15) and all(width > 1 for _, width in asked)
    h = p.r.astype(float)[u] @ p.c1 + p.r.astype(float)[v] @ p.c2
    top, words = h @ p.qc.T.astype(float) + p.bc, h @ p.q.T.astype(float) + p.b
    own = lambda i: words[i][cls_of == cls_of[ids[i]]]
    plain = [top[i, cls_of[w]] - np.log(np.exp(top[i]).sum()) + words[i, w] - np.log(np.exp(own(i)).sum()) for i, w in enumerate(ids)]
    assert np.allclose(got, plain, atol=0.02)
    # a text alone, and each of its contexts in a block of its own, has the same scores to the last bit
    texts = [ids[a : a + 7].tolist() + [lm.STOP] for a in range(0, 70, 7)]
    whole = scorer.log_probs(np.concatenate(texts))
    assert whole.tolist() == [x for t in texts for x in scorer.log_probs(np.array(t)).tolist()]


def test_lm_training_of_words_alone_in_a_class_follows_the_noise():
    """Every noise word of a class of one is its word: one step moves its output as true and noise words together do."""
    counts = np.array([900.0, 50, 40, 30, 20, 10, 5, 1])
    cls_of = np.array([0, 1, 1, 1, 2, 2, 2, 2])
    p = lm.Params.start(counts, cls_of, 3)
    before = lm.Params.of(p.words(), p.classes())
    ids = np.array([0] * 6 + [1])
    lm.train_share(p, ids, cls_of, counts)
    h = np.array([before.r[u] @ before.c1 + before.r[v] @ before.c2 for u, v in [(1, 1), (0, 1), *[(0, 0)] * 4]])
    logit = h @ before.q[0] + before.b[0] - np.log(900.5 / 901.0) - np.log(lm.NOISE)
    e = 1 - (1 + lm.NOISE) / (1 + np.exp(-logit))
    g = np.append(e @ h, e.sum()) / len(ids)
    moved = np.append(p.q[0] - before.q[0], p.b[0] - before.b[0])
    assert np.allclose(moved, lm.RATE * 0.3 * g / np.sqrt(1e-3 + g * g), rtol=1e-3, atol=1e-5)


def test_lm_score_of_equal_texts(spark):
    """Equal texts have equal scores, whatever stands beside them, however the table is dealt and read; long texts too."""
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    long = " ".join(r.text for r in docs.orderBy("doc_id").limit(150).collect())
    rows = docs.unionByName(spark.createDataFrame([(10_000_003, long), (10_000_007, long), (10_000_009, long)], DOCS))
    keep = "doc_id", "score", "base_score", "n_tokens"
    one = lm.score_texts(rows.repartition(1)).select(*keep).collect()
    many = lm.score_texts(rows.repartition(11, "text").sortWithinPartitions(F.desc("doc_id"))).select(*keep).collect()
    assert sorted(one) == sorted(many)
    by_text, text = {}, {r.doc_id: r.text for r in rows.collect()}
    for r in one:
        by_text.setdefault(text[r.doc_id], set()).add((r.score, r.base_score))
    assert len(by_text) < len(text) and all(len(x) == 1 for x in by_text.values())


def test_lm_shares():
    assert lm.shares(0) == lm.shares(500_000) == 1 and 1 < lm.shares(10**8) < lm.shares(10**10) < 10**10 // 500_000


def test_lm_addend_and_rare_share(spark):
    assert lm.best_addend({}) == 1.0 and lm.best_addend({1: 100}) >= 64 and lm.best_addend({1: 5, 2: 5, 90: 100}) <= 2
    # all words known to the model but rare: shares of rare words and of one unseen word sum to one
    rows = [(i, f"a a a a b{i}") for i in range(30) if zlib.crc32(str(i).encode()) % 7 != 2]
    probes = [(1000 + i, f"b{r[0]}") for i, r in enumerate(rows)] + [(2000, "never")]
    probes = [(i, t) for i, t in probes]
    docs = spark.createDataFrame(rows + probes, DOCS)
    got = {r.doc_id: r for r in lm.score_texts(docs, F.col("doc_id") >= 1000).collect()}
    kinds = len({round(got[i].score, 9) for i, t in probes if t != "never"})
    assert kinds == 1 and got[2000].n_known == 1 and got[2000].score < got[1000].score


def test_lm_odd(spark):
    got = {r.doc_id: r for r in lm.score_texts(odd_docs(spark, [(1, None), (None, "a b"), (2, "")])).collect()}
    assert got[1].n_tokens == 1 and got[None].n_tokens == 3 and not got[None].held_out
    assert lm.score_texts(odd_docs(spark, [(1, "x")]).limit(0)).count() == 0


def toxic_docs(spark, n=600):
    rng = random.Random(9)
    plain, bad = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)], ["vexgrub", "smordid", "plutzig", "qworfel"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice(plain) for _ in range(80)]
        for _ in range(5 * toxic):
            w[rng.randrange(80)] = rng.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out(spark):
    rows = toxic_docs(spark)
    model = toxicity.fit(rows.where("doc_id % 3 <> 0"))
    got = toxicity.score(rows.where("doc_id % 3 = 0"), model).collect()
    hit = sum(r.predicted == r.toxic for r in got)
    assert hit >= 0.95 * len(got) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_toxicity_odd(spark):
    rows = toxic_docs(spark, 40)
    model = toxicity.fit(rows.where("toxic = 0"))
    odd = odd_docs(spark, [(1, None), (2, ""), (None, "x" * 300_000)])
    got = toxicity.score(odd, model).collect()
    assert len({r.score for r in got}) == 1 and got[0].predicted == 0
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.fit(rows.limit(0)).weights


# --- queries ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_equal_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = c.execute(Q.oracle_sql()[name]).df(), Q.queries()[name](spark, sf).toPandas()
    names = sorted(want.columns)
    rows = lambda d: sorted(str([None if pd.isna(x) else float(x) if type(x) in (int, float) else x for x in r]) for r in d[names].astype(object).values.tolist())
    assert names == sorted(got.columns) and rows(got) == rows(want)


def test_pipeline_odd_tables(spark, tmp_path):
    import corpus_pipeline as P

    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d e f", "x"), (3, long, "x"), (4, long, None), (5, "a b c d e f", "x"), (5, "a b c d e f", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (1, 1), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "q r s")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {2, 4, 5} and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{t}.parquet")
    assert P.run(spark, f"{tmp_path}/empty").count() == 0


def test_pipeline(spark, sf, texts):
    import corpus_pipeline as P

    docs, kept = read(spark, sf, "documents"), dict(texts)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = P.written(out, "stage")
        left = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert left.items() <= kept.items()
        if name == "exact_dedup":
            best = {}
            for i, t in kept.items():
                best[t] = max(i, best.get(t, i))
            assert set(left) == set(best.values())
        if name == "near_dedup":
            assert set(left) == set(brute_components(list(kept.items()), 80)[0].values())
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
            assert set(kept) - set(left) == {i for i, t in kept.items() if decontaminated(t, items)}
        kept = left
    last = P.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(kept)


def decontaminated(text, items):
    words = decontaminate.words_of(text)
    line = b" " + b" ".join(words) + b" "
    return any(w in line for _, t in items for w in decontaminate.item_windows(t, 10))
