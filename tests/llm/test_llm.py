"""Operators against brute force on small tables, with nulls, empty texts, ties, repeated rows and other columns."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from veilspark.llm import bpe, chat, fingerprints, html, html_samples, language, mixing, simhash, skew, suffix, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, fp long, size string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


def table(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "no id here", None, None, None, None)], DOCS)


def test_simhash_links_equal_brute_force(spark):
    rng = random.Random(1)
    base = [words(rng, 60) for _ in range(25)]
    texts = [*base, *[b + " " + words(rng, 1) for b in base], base[0], None, "", "one two", "One  two"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, texts)).collect() if r["doc_id"] is not None}

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fp(t) for t in texts]
    comp = list(range(len(f)))
    for _ in f:
        for i in range(len(f)):
            for j in range(len(f)):
                if (f[i] ^ f[j]).bit_count() <= 3:
                    comp[i] = min(comp[i], comp[j])
    assert [got[i]["fingerprint"] for i in range(len(f))] == [f"{x:016x}" for x in f]
    assert [got[i]["component_id"] for i in range(len(f))] == comp


def test_one_of_each_keeps_rows_without_id(spark):
    rng = random.Random(13)
    base = [words(rng, 400) for _ in range(8)]
    near = base[0].rsplit(" ", 1)[0]  # the last word cut off
    assert 0 < (simhash.fingerprint(base[0]) ^ simhash.fingerprint(near)).bit_count() <= 3
    rows = [(1, base[0]), (None, near), *[(None, t) for t in base[1:5]], (None, base[1]), (7, base[5]), (7, base[6]), (7, base[6]), (8, base[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect())
    assert got == Counter([(1, base[0]), *[(None, t) for t in base[1:5]], (7, base[5]), (7, base[6]), (8, base[7])])
    comps = Counter(r["component_id"] for r in simhash.near_duplicates(docs).collect())
    assert comps == Counter({1: 2, None: 5, 7: 3, 8: 1})


def test_large_groups_are_cut_into_tiles(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << i) for i in range(16, 22)] + [base])).view(np.int64)
    rows = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps)], "fp long, rep long")
    for tile in (4, 8192):
        from veilspark.llm.components import connected_components

        got = {r["node"]: r["component"] for r in connected_components(simhash.links(rows, tile=tile)).collect()}
        assert len(set(got.values())) == 40 and len(got) == len(fps)


def test_repeated_passages_equal_brute_force(spark):
    rng = random.Random(2)
    shared, other = words(rng, 80), words(rng, 55)
    texts = [words(rng, 100) + " " + shared, shared + " " + words(rng, 30), words(rng, 20) + " " + other + " " + words(rng, 70), other + " " + shared, words(rng, 49), None, "", words(rng, 200)]
    got = suffix.repeated(table(spark, texts)).collect()
    where = defaultdict(set)
    split = [(t or "").split() for t in texts]
    for i, w in enumerate(split):
        for p in range(len(w) - 49):
            where[tuple(w[p : p + 50])].add(i)
    for i, w in enumerate(split):
        both, later = set(), set()
        for p in range(len(w) - 49):
            docs = where[tuple(w[p : p + 50])]
            if len(docs) > 1:
                both.update(range(p, p + 50))
                if min(docs) < i:
                    later.update(range(p, p + 50))
        mine = [r for r in got if r["doc_id"] == i]
        assert {x for r in mine for x in range(r["start_word"], r["end_word"])} == both
        assert {x for r in mine if r["later"] for x in range(r["start_word"], r["end_word"])} == later
    left = {r["doc_id"]: r["text"] for r in suffix.without_repeats(table(spark, texts)).collect()}
    assert 3 not in left and shared in left[0] and shared not in left[1] and left[4] == texts[4] and left[5] is None


def repeated_words(texts):
    """(later ones, all) of the (text, word) in passages of 50 words that another text holds too, by brute force."""
    where, both, later = defaultdict(set), set(), set()
    split = [t.split() for t in texts]
    for i, w in enumerate(split):
        for p in range(len(w) - 49):
            where[tuple(w[p : p + 50])].add(i)
    for i, w in enumerate(split):
        for p in range(len(w) - 49):
            docs = where[tuple(w[p : p + 50])]
            if len(docs) > 1:
                both.update((i, x) for x in range(p, p + 50))
                if min(docs) < i:
                    later.update((i, x) for x in range(p, p + 50))
    return later, both


def found_words(rows, kind):
    return {(r["doc_id"], x) for r in rows if kind(r) for x in range(r["start_word"], r["end_word"])}


def test_edited_near_copies_equal_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(6):
        base = words(rng, 400).split()
        for _ in range(40):
            texts.append(" ".join(words(rng, 1) if rng.random() < 0.03 else w for w in base))
    got = suffix.repeated(table(spark, texts)).collect()
    later, both = repeated_words(texts)
    assert found_words(got, lambda r: r["later"]) == later and found_words(got, lambda r: True) == both


@pytest.mark.parametrize("hot", [1, 1 << 11])  # with 1 no key is heavy, with 2,048 all keys of so small a table are
def test_hot_anchors_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "MOST_HEAVY", hot)
    rng = random.Random(3)
    shared = words(rng, 60)
    texts = [words(rng, 40) + " " + shared + " " + words(rng, 40) for _ in range(12)]
    got = suffix.repeated(table(spark, texts)).collect()
    assert {r["doc_id"] for r in got} == set(range(12)) and all(r["n_words"] >= 60 for r in got if r["doc_id"] == 5)
    assert {r["doc_id"] for r in got if r["later"]} == set(range(1, 12))


def test_hot_anchors_find_what_the_head_lacks(spark):
    rng = random.Random(12)
    line = words(rng, 40)  # in all documents; too short to be a passage by itself
    ends = [(words(rng, 8), words(rng, 8)) for _ in range(8)]
    texts = [words(rng, 40) + " " + line + " " + words(rng, 40)]
    for i in range(40):  # five documents share each pair of ends around the line, the first document none
        a, b = ends[i % 8]
        texts.append(" ".join([words(rng, 40), a, line, b, words(rng, 40)]))
    got = suffix.repeated(table(spark, texts)).collect()
    later, both = repeated_words(texts)
    assert found_words(got, lambda r: r["later"]) == later and found_words(got, lambda r: True) == both
    assert {i for i, _ in both} == set(range(1, 41))


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own, ref = bpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for alphabet in ("ab", " \n\t", "abcdefgh ", "éüñ漢😀", "0123 .,'s"):
        for n in (0, 1, 30, 500, 3000):
            text = "".join(rng.choices(alphabet, k=n))
            assert own.ids(text) == ref.encode_ordinary(text)
            assert b"".join(x[2] for x in own.document(text)) == text.encode()
    got = bpe.standard(table(spark, ["a b", None, ""])).collect()
    assert [r["n_tokens"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = [rng.normal(size=6).astype("float32").tolist() for _ in range(300)]
    vecs[7], vecs[8], vecs[9], vecs[20] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [0.0] * 5, vecs[21]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in enumerate(vecs) if i not in (7, 8, 9)}
    want = []
    for i in (x for x in q if x % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    texts = [words(rng, rng.randint(1, 30)) for _ in range(200)] + [None, ""]
    sources = ["a" if i % 3 == 0 else "b" if i % 3 == 1 else None for i in range(202)]
    rows = [r for r in mixing.mix_sources(table(spark, texts, sources)).collect()]
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(g[0]["target"] for g in by.values()) - 1.5 * total) < 1e-6 * total
    for g in by.values():
        assert abs(sum(r["taken"] for r in g) - g[0]["target"]) <= max(r["size"] for r in g)
        assert all(r["taken"] <= 2 * r["size"] for r in g) and g[0]["target"] <= 2 * g[0]["source_size"]


def test_fingerprints_are_homomorphic(spark):
    from pyspark.sql import functions as F

    a, b = "One two. Three four!\n", "Five six.\nSeven."
    df = spark.createDataFrame([(0, a + b), (1, "Five six.\nOne two. Three four!\nSeven."), (2, a), (3, b), (4, ""), (5, None)], "doc_id long, text string")
    v = {r["doc_id"]: r["vec"] for r in fingerprints.vectors(df, ["doc_id"], "text").collect()}
    assert v[0] == v[1] and v[4] == v[5] and v[0] != v[2]
    both = spark.createDataFrame([(v[2], v[3], v[0])], "a array<long>, b array<long>, c array<long>")
    got = both.select(fingerprints.combine(F.col("a"), F.col("b")).alias("p"), fingerprints.combine(F.col("c"), F.col("b"), -1).alias("m"), fingerprints.likeness(F.col("c"), F.col("c")).alias("s")).first()
    assert got["p"] == v[0] and got["m"] == v[2] and got["s"] == 1.0


def test_fingerprints_of_very_long_repeats(spark):
    import duckdb
    from pyspark.sql import functions as F

    other = "Something else. And more!"
    texts = ["One two. " * n + tail for n, tail in ((20_000, ""), (10_000, ""), (5_000, ""), (16_384, other), (0, other))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = {r["doc_id"]: r["vec"] for r in fingerprints.vectors(df, ["doc_id"], "text").collect()}
    pairs = spark.createDataFrame([(0, v[0], v[1]), (1, v[1], v[2]), (2, v[0], v[2]), (3, v[3], v[4])], "i int, a array<long>, b array<long>")
    near = {r["i"]: r["s"] for r in pairs.select("i", fingerprints.likeness(F.col("a"), F.col("b")).alias("s")).collect()}
    assert near[0] == near[1] == pytest.approx(0.8) and near[2] == pytest.approx(1 - 225 / 425) and near[3] < 0.01
    back = spark.createDataFrame([(v[1], v[0], v[2])], "a array<long>, b array<long>, c array<long>")
    both = fingerprints.combine(fingerprints.combine(F.col("a"), F.col("b"), -1), F.col("b"))
    assert back.select(both.alias("x")).first()["x"] == v[1]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts))[:3])
    got = sorted(map(tuple, fingerprints.fingerprint_documents(df.filter("doc_id < 3")).collect()))
    want = sorted(con.execute(fingerprints.SQL).fetchall())
    assert [r[:5] for r in got] == [r[:5] for r in want] and [r[5:] for r in got] == [pytest.approx(r[5:]) for r in want]


def test_chat_keeps_maximal_conversations(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, None, "hi"), (None, 0, "user", "x")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["n_turns"]) for r in got} == {(2, 2), (4, 1)}
    assert next(r for r in got if r["conv_id"] == 2)["rendered"] == "<|user|>\nhi\n<|assistant|>\nyo\n"


def test_html_on_held_out_pages():
    trees, scores = html.model(), []
    for source in html_samples.pages(120, seed=99):
        want = Counter(w for _, t, _ in html.Page(source).texts() if html_samples.MARK in t for w in t.replace(html_samples.MARK, "").split())
        got = Counter(html.extract([source.replace(html_samples.MARK, "")], trees)[0].split())
        scores.append(1.0 if not want and not got else 2 * (want & got).total() / max(1, want.total() + got.total()))
    assert np.mean(scores) > 0.94
    assert html.extract([None, "", "<p"], trees)[:2] == ["", ""]


@pytest.mark.parametrize("name", ["language", "toxicity"])
def test_classifiers_on_held_out_documents(spark, name):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    if name == "language":
        got = language.query(spark, d).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
        assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
        odd = language.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !")], "doc_id long, text string"), language.fit(docs)).collect()
        assert [r["lang_pred"] for r in odd] == ["und"] * 3
    else:
        got = toxicity.query(spark, d).join(labels.groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null").collect()
        pairs = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in got for b in got if a["toxic"] == 1 and b["toxic"] == 0]
        assert np.mean(pairs) > 0.85 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0
    assert suffix.repeated(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert fingerprints.fingerprint_documents(empty).count() == 0
    assert language.identify(empty.select("doc_id", "text"), language.fit(empty)).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
