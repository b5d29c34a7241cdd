"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for all operators and stages."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from veilspark.llm import bpe, chat, fingerprints, html, language, mixing, simhash, skew, suffix, topk, toxicity

CLASH = "score lang_pred ambiguous _id _same _kept _cuts _times _copy _words _source _size _place _heavy fp unit key n start c doc n_tokens ids component_id fingerprint _range _tie size times later".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


def odd(spark, empty=False):
    """Rows without id, without text, empty, without letters, of one word, very long, repeated, and ids with two texts."""
    rng = random.Random(21)
    long = words(rng, 30_000)
    rows = [(None, words(rng, 80)), (None, None), (None, ""), (1, None), (2, ""), (3, "½ ² ① 12 !"), (4, "one"), (5, long), (6, long + " tail"), (7, words(rng, 60)), (7, words(rng, 70)), (8, "same same"), (8, "same same"), (9, " \t\n")]
    full = [(i, t, "en" if t else None, None if i in (1, 4) else "s", len(t or ""), *["x"] * len(CLASH)) for i, t in rows]
    return spark.createDataFrame([] if empty else full, SCHEMA)


def labels(spark, empty=False):
    return spark.createDataFrame([] if empty else [(5, 1, 0), (None, 1, 1), (7, None, None), (7, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")


def plain(docs):
    return Counter((r["doc_id"], r["text"]) for r in docs.collect())


OPERATORS = {
    "language": lambda s, d: language.identify(d, language.fit(d)),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s))),
    "suffix": lambda s, d: suffix.without_repeats(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "mixing": lambda s, d: mixing.mix_sources(d, labels(s)),
    "bpe": lambda s, d: bpe.standard(d),
    "fingerprints": lambda s, d: fingerprints.fingerprint_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row_of_an_odd_table(spark, name):
    docs = odd(spark)
    want = Counter(r["doc_id"] for r in docs.collect())
    got = Counter(r["doc_id"] for r in OPERATORS[name](spark, docs).collect())
    assert got == want
    assert OPERATORS[name](spark, odd(spark, empty=True)).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_tables(spark, tmp_path, stage):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs, run = odd(spark), corpus_pipeline.STAGES[stage][1]
    got = run(spark, docs, str(tmp_path))
    if stage < 4:
        assert got.columns == docs.columns
    assert run(spark, odd(spark, empty=True), str(tmp_path)).count() == 0
    rows, all_rows = plain(got) if stage < 4 else Counter(r["doc_id"] for r in got.collect()), plain(docs)
    if stage == 0:
        assert rows == Counter({k: v for k, v in all_rows.items() if any(map(str.isalpha, k[1] or ""))})
    elif stage == 1:
        gone = all_rows - rows
        assert set(rows.values()) == {1} and (8, "same same") in gone and (6, [t for i, t in all_rows if i == 6][0]) in gone
        assert {(i, t) for i, t in rows if not (t or "").strip()} == {(1, None)}  # the fingerprint 0 with the smallest doc_id
    elif stage == 2:
        cut = next(t for i, t in rows if i == 6) if any(i == 6 for i, _ in rows) else ""
        assert cut.strip() == "tail" and all_rows - rows == Counter([k for k in all_rows if k[0] == 6])
    elif stage == 3:
        assert set(rows) <= set(all_rows) and all(v <= 2 * all_rows[k] for k, v in rows.items())
    else:
        assert rows == Counter(i for i, _ in all_rows.elements())


def test_vectors_and_conversations_and_pages(spark):
    vecs = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [3.0]), (7, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [1.0]), (9, None), (8, []), (100, [float("inf")])]
    df = spark.createDataFrame([(i, v, 1, 2, 0.0) for i, v in vecs], "vec_id long, embedding array<float>, block int, kind int, least double")
    got = [tuple(r) for r in topk.top_k(df, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 256 * 256 * 5), (0, 2, 7, 256 * 256 * 5), (0, 3, 50, 256 * 256 * 3), (50, 1, 0, 256 * 256 * 3), (50, 2, 0, 256 * 256 * 3), (50, 3, 3, 256 * 256 * 3)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    turns = [(1, None, "a", "x"), (1, 0, None, None), (1, 0, None, None), (2, 5, "a", ""), (3, 5, "a", ""), (None, 1, "a", "b"), (4, 0, "u", "t" * 100_000)]
    talk = spark.createDataFrame([(*t, 1, "p", 2) for t in turns], "conv_id long, turn long, role string, text string, i int, prefix string, n int")
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.format_conversations(talk).collect()}
    assert got == {1: (3, "<|a|>\nx\n" + "<|unknown|>\n\n" * 2), 2: (1, "<|a|>\n\n"), 4: (1, "<|u|>\n" + "t" * 100_000 + "\n")}
    assert chat.format_conversations(talk.limit(0)).count() == 0
    long = "<article>" + "<p>Some words, and more of them here.</p>" * 3000 + "</article>"
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", long, "x"), (None, None, "", "x"), (2, "v", "<ul>" * 20_000, "x")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["n_chars"], len(r["text"])) for r in html.main_text(pages).collect())
    want = len(" ".join(["Some words, and more of them here."] * 3000))
    assert got == [(0, 0, 0), (1, 0, 0), (1, want, want), (2, 0, 0)]
    assert html.main_text(pages.limit(0)).count() == 0


def test_a_very_long_conversation_is_linear(spark):
    n = 20_000
    turns = spark.range(n).selectExpr("1 as conv_id", "id as turn", "'u' as role", "cast(id as string) as text")
    both = turns.unionByName(turns.filter(f"turn < {n - 1}").selectExpr("2 as conv_id", "turn", "role", "text"))
    assert [(r["conv_id"], r["n_turns"]) for r in chat.format_conversations(both).collect()] == [(1, n)]


def test_heavy_keys_are_joined_without_loss(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_HEAVY", 4)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 30 + list(range(3, 23)) + [99])], "k int, i int")
    keys = rows.filter("k <> 99").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 10 as v")
    got = sorted((r["k"], r["i"], r["v"]) for r in skew.joined(rows, keys, "k").collect())
    assert got == sorted((r["k"], r["i"], r["k"] * 10) for r in rows.collect() if r["k"] != 99)


def test_threshold_algorithm_scores_a_part_of_the_candidates():
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.maximum(rng.normal(size=(4000, 16)) - 1, 0))
    lists = topk.Lists(np.arange(len(x)), x)
    for i in range(40):
        ids, score = lists.top(i, x[i], 5)
        s = x @ x[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:5]
        assert ids.tolist() == order and score.tolist() == s[order].astype(int).tolist()
        low, _ = lists.top(i, x[i], 5, float(score[2]))
        assert low[:3].tolist() == order[:3]
    assert lists.scored < 0.6 * lists.offered


def test_halves_are_joined():
    import public_tokenizers as P

    enc, calls = bpe.Encoder(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN), [0]
    join = enc.join

    def counted(a, b):
        calls[0] += 1
        return join(a, b)

    enc.join = counted
    rng = random.Random(5)
    texts = {"".join(rng.choices("abcdeinrst", k=rng.randint(9, 14))) for _ in range(200)}
    long = [t for t in texts if t.encode() not in enc.ranks]
    assert [enc.ids(t) for t in long] == [list(enc.merge(t.encode())) for t in long]
    assert calls[0] >= len(long)


def test_language_decoding_by_plain_loops():
    rng = np.random.default_rng(4)
    for n in (2, 4, 9):
        codes = language.codewords(n)
        m = language.Model(tuple(f"l{i}" for i in range(n)), codes, np.zeros((1, 1)), np.zeros(1), 2.0)
        for _ in range(20):
            f = rng.normal(size=codes.shape[1])
            loss = [sum(np.log1p(np.exp(-4.0 * c * v)) for c, v in zip(row, f)) for row in codes]
            lang, score, _ = m.decode(f)
            assert lang == f"l{int(np.argmin(loss))}" and score == pytest.approx(1 / sum(np.exp(min(loss) - x) for x in loss))


def test_toxicity_by_plain_loops(spark):
    rng = random.Random(6)
    rows = [(i, int(i % 5 == 0), " ".join("grumpf" if i % 5 == 0 and rng.random() < 0.2 else words(rng, 1) for _ in range(120))) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    marked = spark.createDataFrame([(i, y) for i, y, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, marked)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.7) == (y == 1) for i, y, _ in rows]) > 0.97
    packers = [zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.ordinary, model.toxic)]
    for i, _, t in rows[:30]:
        w = t.split()
        saved = [len(packers[0].compress(x)) - len(packers[1].compress(x)) for x in (f" {' '.join(w[j : j + 8])} ".encode() for j in range(0, len(w), 8))]
        over = [max(s - 2, 0) for s in saved]
        x = [min(max(saved), 12), min(sum(sorted(saved)[-2:]), 20), np.log1p(sum(over)), np.sqrt(np.mean(over)), np.mean(saved), np.mean([s >= 3 for s in saved])]
        z = model.weights[0] + sum(a * (b - m) / d for a, b, m, d in zip(model.weights[1:], x, model.mean, model.spread))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_tree_decoding_by_enumeration():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(2, 7))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        own, logit, hidden = rng.integers(0, 3, n) * 20.0, rng.normal(size=n) * 3, (rng.random(n) < 0.15).astype(float)
        gain = np.where(hidden > 0, -50.0, np.clip(logit, -4, 4) * np.where(own > 0, np.log1p(own), 0.7))

        def worth(states):
            total = 0.0
            for i, s in enumerate(states):
                if i and (states[parent[i]] == 1 and s != 1 or states[parent[i]] == 0 and s == 2):
                    return -np.inf
                total += gain[i] if s == 0 else -gain[i] if s == 1 else (-gain[i] if own[i] > 0 else 0.0) - html.MIX_COST
                total -= html.KEEP_COST if i and s == 1 and states[parent[i]] == 0 else 0.0
            return total

        best = max(worth(s) for s in itertools.product(range(3), repeat=n))
        kept = html.decode(parent, own, logit, hidden)
        assert max(worth(s) for s in itertools.product(range(3), repeat=n) if all((x == 0) == k for x, k in zip(s, kept))) == pytest.approx(best)


def test_markup_with_stray_quotes_stays_out():
    page = html.Page('<article><p>Go <a title="it"s fine">here</a> now</p><!-- > --><p a=\'x>y\'>two</p></article><p cut="')
    assert [t for _, t, _ in page.texts()] == ["Go here now", "two"]


def test_a_refined_cut_equals_the_plain_one(spark, monkeypatch):
    rng = random.Random(8)
    texts = [words(rng, rng.randint(1, 30)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    plain_ = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "SORTED_ROWS", 0)
    assert sorted(map(tuple, mixing.mix_sources(docs).collect())) == plain_


def test_next_document_over_many_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(None, f"a{i}.") for i in range(90)] + [(5, f"b{i}.") for i in range(70)] + [(i, f"c{i}.") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text")
    got = fingerprints.with_next(df).withColumn("h", F.xxhash64("text")).collect()
    order = sorted(got, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    assert len(got) == len(rows) and len({r["_range"] for r in got}) > 4
    assert all(r["next_text"] == order[(i + 1) % len(order)]["text"] for i, r in enumerate(order))


def test_pipeline_equals_brute_force(spark, tmp_path):
    import duckdb
    import public_tokenizers as P
    import tiktoken

    rng = random.Random(9)
    shared, base = words(rng, 70), [words(rng, 90) for _ in range(30)]
    texts = [*base, *[b + " " + words(rng, 1) for b in base[:6]], *base[6:10], *[words(rng, 40) + " " + shared + " " + words(rng, 30) for _ in range(5)], "12 34", None, ""]
    rows = [(i, t, "en" if i % 2 else "de", "abc"[i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = {i: t for i, t, *_ in rows if any(map(str.isalpha, t or ""))}
    prints, comp = {i: simhash.fingerprint(t) for i, t in kept.items()}, {i: i for i in kept}
    for _ in kept:
        for i, j in itertools.permutations(kept, 2):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                comp[i] = min(comp[i], comp[j])
    kept = {i: kept[i] for i in sorted(set(comp.values()))}
    first: dict[tuple[str, ...], int] = {}
    split = {i: t.split(" ") for i, t in kept.items()}
    for i in sorted(split):
        for p in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][p : p + 50]), i)
    for i, w in split.items():
        gone = {x for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for x in range(p, p + 50)}
        kept[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, t, "abc"[i % 3]) for i, t in kept.items()])
    con.execute(f"create view labels as from '{tmp_path}/labels.parquet/*.parquet'")
    enc, want = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}), Counter()
    for i, size, _, _, taken in con.execute(mixing.SQL).fetchall():
        ids = enc.encode_ordinary(kept[i])
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(kept[i].encode()).hexdigest()] += taken // size
    assert got == +want
