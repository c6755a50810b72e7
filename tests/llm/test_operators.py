"""Each operator against a plain version of itself, SQL or held-out labels, and on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import binary, common, components, decontaminate, langid, linedup, lm, mixer, mixing, neardup, quality_model, quality_rules, registry, token_counts, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = str(public_tokenizers.path("word_bpe_49k.json"))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


# kernels


def test_hash_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 62, 5000).astype(np.uint64))
    t = common.HashTable(4)
    for part in np.array_split(np.arange(len(keys)), 7):
        t.add(keys[part], part.astype(np.int32))
    assert (t.get(keys) == np.arange(len(keys))).all()
    assert (t.get(keys + np.uint64(1)) == -1).mean() > 0.99


def test_words_and_chunks():
    col = pa.array([b"a bc", None, b"", b" d\te ", b"f"], pa.binary())
    for most in (1, 3, 100):
        got = []
        for _, _, data, offs in common.chunks(col, most):
            s, e, first = common.word_bounds(data, offs, common.BLANK_WORD)
            h = common.word_hashes(data, s, e)
            assert (h == common.hash_words([data[a:b].tobytes() for a, b in zip(s, e, strict=True)])).all()
            got += [[data[a:b].tobytes() for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
        assert got == [[b"a", b"bc"], [], [], [b"d", b"e"], [b"f"]]


# 1 decontamination


def matched(spark, docs, items, **kw):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in decontaminate.matches(docs, bench, **kw).withColumn("hit", decontaminate.n_hit(decontaminate.F.col("words"))).collect()}


def test_windows_and_short_items(spark):
    ten = "a b c d e f g h i j"
    items = [(1, ten + " k"), (2, "short one"), (3, None), (4, ""), (10, "b c d e f g h i j k l")]
    docs = spark.createDataFrame([(1, "x " + ten.upper() + "! y"), (2, "a short  one, a short"), (3, "a b c d e f g h i"), (4, None), (5, "b c d e f g h i j k")], "doc_id long, text string")
    got = matched(spark, docs, items)
    assert [(got[i].n_words, got[i].hit, got[i]["items"]) for i in range(1, 6)] == [(12, 10, ["1"]), (5, 2, ["2"]), (9, 0, []), (0, 0, []), (10, 10, ["1", "10"])]
    shards = matched(spark, docs, items, shard_words=5)
    assert {i: (r.hit, r["items"]) for i, r in shards.items()} == {i: (r.hit, r["items"]) for i, r in got.items()}


def test_cut(spark, edges, nothing):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    text = "Before it all, which is long enough to stay here for now and more. One two three four five six seven eight nine ten eleven twelve. After it."
    out = decontaminate.decontaminate(spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long"), bench).first()
    assert "seven" not in out.text and out.text.startswith("Before") and out.text.endswith("After it.") and out.n_chars == len(out.text)
    left = decontaminate.decontaminate(edges, bench).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [0, 1, 2, 5, 6, 7]
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert decontaminate.decontaminate(edges, bench.limit(0)).count() == edges.count()


def test_shards_decide_together(spark):
    """Coverage is of all shards' hits, and a cut that brings an earlier shard's item together is cut again."""
    bench = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, "k l m n")], "item_id long, text string")
    rows = [(1, "a b c d x e f g h y z w v"), (1, "a b c d x e f g h y z w v u t s r q o p"), (2, "k l e f g h m n and much more text that stays here"), (2, "nothing of it"), (2, "nothing of it"), (None, None)]
    df = spark.createDataFrame([(k, t, len(t or "")) for k, t in rows], "doc_id long, text string, n_chars long")
    one, more = (sorted(map(tuple, decontaminate.decontaminate(df, bench, shard_words=n).collect()), key=str) for n in (1000, 5))
    assert one == more and len(one) == 5 and not any("k l" in (t or "") for _, t, _ in one)
    one, more = (sorted(map(tuple, decontaminate.matches(df, bench, shard_words=n).select("doc_id", "n_words", "items", decontaminate.n_hit("words")).collect()), key=str) for n in (1000, 5))
    assert one == more and len(one) == 6


def test_cuts_of_several_shards_bear_any_names(spark):
    bench = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b c d and a good many more words than that", 5, "x", True, 9), (2, "nothing of it", 6, "y", False, 8), (3, None, 7, "z", None, 7)], "doc_id long, text string, _row_number long, _new string, _gone boolean, `a.b` long")
    out = sorted(map(tuple, decontaminate.decontaminate(df, bench, shard_words=4).collect()))
    assert out == [(1, "\n and a good many more words than that", 5, "x", True, 9), (2, "nothing of it", 6, "y", False, 8), (3, None, 7, "z", None, 7)]


def test_shards_go_one_at_a_time(spark, edges, monkeypatch):
    """No two shards' automata are broadcast at once, and each is unpersisted before the next is sent."""
    live, most = [], []
    send = type(spark.sparkContext).broadcast

    def broadcast(sc, value):
        out = send(sc, value)
        live.append(out)
        most.append(len(live))
        gone = out.unpersist
        out.unpersist = lambda *a: (live.remove(out), gone(*a))
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    bench = spark.createDataFrame([(i, f"one two three four w{i} x{i}") for i in range(6)], "item_id long, text string")
    assert decontaminate.matches(edges, bench, shard_words=7).count() == edges.count()
    assert len(most) == 6 and max(most) == 1


# 2 quality rules


def test_rules(spark, docs, edges, nothing):
    got = {r.doc_id: r for r in quality_rules.judged(edges.drop(*quality_rules.COUNTS, "kept")).collect()}
    assert got[0].base_failed and not got[0].kept and got[0].n_words == 0
    assert got[3].n_words == 12 and got[3].kept and got[6].n_repeat_words == 30_000 and got[6].base_failed
    assert quality_rules.pass_rules(nothing).count() == 0
    kept = quality_rules.pass_rules(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 4]
    assert quality_rules.pass_rules(docs).count() == quality_rules.judged(docs).where("kept").count()


def test_rules_bear_any_names(spark, docs):
    from pyspark.sql import functions as F

    more = docs.withColumns({"x1": F.lit(7), "d2": F.lit("d"), "lk": F.lit(1), "l11": F.lit(2), "cell": F.lit("c"), "st": F.lit(3), "a.b": F.lit(4), "_row": F.lit(5)})
    got = quality_rules.judged(more)
    assert set(got.columns) == {*more.columns, *quality_rules.COUNTS, "base_failed", "kept"} - {"text"}
    r = got.first()
    assert (r.x1, r.d2, r.lk, r.l11, r["cell"], r.st, r["a.b"], r["_row"]) == (7, "d", 1, 2, "c", 3, 4, 5)
    assert {r.doc_id for r in got.where("kept").collect()} == {r.doc_id for r in quality_rules.judged(docs).where("kept").collect()}


def test_least_determinant(spark):
    """The fit of a cell against a plain search: steps from both starts, and the least determinant; by other code."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (300, 5)) @ rng.normal(0, 1, (5, 5)), rng.normal(9, 0.5, (60, 5))])
    df = spark.createDataFrame([("l", "s", False, *map(float, r)) for r in x], "lk string, sk string, base_failed boolean, x1 double, x2 double, x3 double, x4 double, x5 double")
    got = quality_rules.fit(common.staged(df, "points")).first()
    ridge = np.diag(np.square(quality_rules.LEAST))
    mid = np.median(x, 0)
    starts = [(mid, np.diag(np.maximum(1.4826 * np.median(abs(x - mid), 0), quality_rules.LEAST) ** 2)), (x.mean(0), np.cov(x.T, bias=True) + ridge)]
    ends = []
    for m, c in starts:
        for _ in range(quality_rules.STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            near = x[np.argsort(d)[: math.ceil(quality_rules.HELD * len(x))]]
            m, c = near.mean(0), np.cov(near.T, bias=True) + ridge
        ends.append((np.linalg.det(c), m))
    assert np.allclose([got[f"m{i}"] for i in range(1, 6)], min(ends, key=lambda e: e[0])[1], atol=0.15)
    assert math.isclose(math.log(np.prod([got[f"l{i}{i}"] for i in range(1, 6)]) ** 2), math.log(min(ends, key=lambda e: e[0])[0]), abs_tol=0.3)


def test_rules_are_native(docs):
    plan = quality_rules.pass_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 3 quality classifier


def test_additive_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # a pure interaction
    m = quality_model.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert quality_model.fit(x[:5], np.ones(5)).score(x).min() > 0.99
    assert (quality_model.fit(x[:0], y[:0]).score(x) == 0.5).all()


def test_held_out_quality(spark, edges, nothing):
    sf = "/root/testdata/sf0.01"
    r = quality_model.op3_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(r) > 50 and sum(x.predicted == x.quality for x in r) / len(r) > 0.95
    scored = quality_model.score(edges, quality_model.Model()).collect()
    assert len(scored) == edges.count() and all(x.score == 0.5 for x in scored)
    assert quality_model.score(nothing, quality_model.Model()).count() == 0


# 4 mixing


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["b"] == 30 and got[None] == 15 and math.isclose(sum(got.values()), 1115) and got["a"] < 300


def test_mix_of_repeated_ids(spark):
    """Rows of one key are taken each by itself, so that the mix holds as many words as planned."""
    rows = [(k % 3 if k % 4 else None, f"s{k % 2}", " ".join(["w"] * (1 + k % 5)), k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n long")
    plan = mixing.mix(df)
    out = mixing.mixed(df).collect()
    assert sum(len(r.text.split()) for r in out) == plan.agg({"taken": "sum"}).first()[0] <= sum(len(t.split()) for _, _, t, _ in rows)


def test_language_against_brute_force(spark, docs):
    some = [(r.doc_id, r.text, r.lang) for r in docs.where("doc_id < 40").collect()]
    some += [(900, "aa bb aa cc bb dd", "en"), (901, "bb aa", None)]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(df, langid.F.col("doc_id") % 4 != 2).collect()}

    def counts(text):
        out = collections.Counter()
        for w in "".join(c if c.isalpha() else " " for c in text or "").split():
            ls = [ord(c.lower()[0]) for c in w]
            at = [0, *ls, 0]
            out.update(ls)
            out.update((a << 21) | b | 1 << 63 for a, b in zip(at, at[1:]))
            out.update((a << 42) | (b << 21) | c for a, b, c in zip(at, at[1:], at[2:]))
        return out

    ranked = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]]
    by = collections.defaultdict(collections.Counter)
    for k, t, lang in some:
        if lang and k % 4 != 2:
            by[lang] += counts(t)
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in by.items()}
    for k, t, _ in some:
        own = ranked(counts(t))
        if not own:
            assert got[k] == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[k][0] == best and math.isclose(got[k][1], 1 - far[best] / (len(own) * langid.PROFILE), abs_tol=1e-9)


def test_additive_scores_against_brute_force():
    """A score is the sum of one look-up for each feature and pair, found here bin by bin."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 4))
    m = quality_model.fit(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float))
    for row, p in zip(x[:60], m.score(x[:60]), strict=True):
        at = lambda edges, v: sum(v >= e for e in edges)
        total = m.base + sum(t[at(e, v)] for e, t, v in zip(m.edges, m.tables, row, strict=True)) + sum(t[at(m.coarse[j], row[j]), at(m.coarse[k], row[k])] for j, k, t in m.pairs)
        assert math.isclose(p, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_mix(spark, docs, edges, nothing):
    rows = mixing.mix(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) and all(r.taken <= 3 * r.size for r in rs)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert mixing.mix(nothing).count() == 0
    assert {r.doc_id: r.size for r in mixing.mix(edges.drop("size")).collect()}[6] == 30_000
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    odd = edges.withColumnRenamed("node", "a.b")
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() > 0


# 5, 7 tokens

ODD = ["", "a.b", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "don't. I'll, U.S. ...., a..", "é.̈ é. Á H̱ ẖ", "İstanbul ΣΑΣ ß ÿ ÷x", "\x1c a\x85b\xa0c", "日本語 テキスト. 한국어", "x" * 70 + ". " + "y" * 300, "123.45, 6.", "(w) a(b)c 's ''s !'s '!s", "½ ② ×÷ª º ﬁ"]


def test_tokens(library, texts):
    all_texts = [*ODD, None, *texts.values()]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in all_texts]
    col = pa.array([None if t is None else t.encode() for t in all_texts], pa.binary())
    for enc in (tokens.Encoder(VOCAB, ready=tokens.frequent(VOCAB)), tokens.Encoder(VOCAB, table_words=50)):
        assert enc.counts(col).tolist() == [len(w) for w in want]
        got = np.concatenate([ids for ids, _ in enc.ids(col, 2)])
        assert got.tolist() == [i for w in want for i in [*w, 2]]


def test_counts(spark, edges, nothing, library):
    got = {r.doc_id: r for r in token_counts.token_counts(edges, VOCAB).collect()}
    assert (got[0].n_bytes, got[0].n_tokens) == (0, 0) and got[6].over_limit and not got[3].over_limit
    assert got[5].n_tokens == len(library.encode("ÉCOLE naïve — 日本語 \U0001f600 x").ids)
    assert token_counts.token_counts(nothing, VOCAB).count() == 0


def test_binary_round_trip(spark, sf, texts, library, edges, nothing):
    start = 0
    got = {r.doc_id: r for r in binary.op7_binary_output(spark, sf).collect()}
    for k in sorted(texts):
        ids = np.array([*library.encode(texts[k], add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    odd = binary.round_trip(edges, VOCAB).orderBy("start").collect()
    assert odd[0].doc_id is None and [r.doc_id for r in odd[1:]] == [0, 1, 2, 3, 4, 4, 5, 6, 7] and odd[1].n_tokens == 1
    assert binary.round_trip(nothing, VOCAB).count() == 0


# 6 language


def test_language(spark, edges, nothing):
    sf = "/root/testdata/sf0.01"
    r = langid.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in r) / len(r) > 0.98 and all(0 <= x.score <= 1 for x in r)
    model = langid.profiles(edges)
    got = {x.doc_id: x for x in langid.predict(edges, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[6].lang_pred == "en" and got[0].score == 0
    assert langid.predict(nothing, model).count() == 0 and {x.lang_pred for x in langid.predict(edges, langid.profiles(nothing)).collect()} == {"und"}


def test_language_blocks(spark, edges, monkeypatch):
    model = langid.profiles(edges)
    whole = sorted(map(str, langid.predict(edges, model).collect()))
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    assert sorted(map(str, langid.predict(edges, model).collect())) == whole


# 8 near duplicates


def plain_components(texts, percent=85):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    r, keys = neardup.Roots(len(sets)), sorted(sets)
    inverted = collections.defaultdict(list)
    for i, k in enumerate(keys):
        common_ = collections.Counter(j for x in sets[k] for j in inverted[x])
        for j, n in common_.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[keys[j]]) - n):
                r.join(i, j)
        for x in sets[k]:
            inverted[x].append(i)
    return {k: (len(sets[k]), keys[r.find(i)]) for i, k in enumerate(keys)}


@pytest.fixture(scope="module")
def family(spark):
    """A text with a thousand variants of it, of which many are near to one another only by way of others."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    out = {}
    for k in range(300):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            w[at] = f"v{rng.integers(1000)}"
        out[k] = " ".join(w)
    for k in range(300, 340):
        out[k] = " ".join(f"u{rng.integers(50)}" for _ in range(60))
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates(spark, texts, family, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BUCKET", block)
    both = family | {k + 1000: t for k, t in texts.items()}
    df = spark.createDataFrame(list(both.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == plain_components(both)


def test_pipeline_takes_four_fifths(spark, sf):
    import corpus_pipeline as p

    w = [f"w{i}" for i in range(104)]
    texts = {1: " ".join(w), 2: " ".join([*w[:-11], *(f"v{i}" for i in range(11))]), 3: " ".join([*w[:-14], *(f"u{i}" for i in range(14))])}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(100)} for k, t in texts.items()}
    assert [len(sets[1] & sets[k]) / len(sets[1] | sets[k]) >= 0.8 for k in (2, 3)] == [True, False] and len(sets[1] & sets[2]) / len(sets[1] | sets[2]) < 0.85
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in p.near_duplicates(spark, df, sf).collect()) == [1, 3]
    assert (neardup.band_count(85), neardup.band_count(80)) == (24, 35)


def test_near_duplicate_edges(spark, edges, nothing):
    got = {r.doc_id: r for r in neardup.near_duplicates(edges).collect()}
    assert got[0].n_shingles == 0 and got[0].kept and got[2].component_id == 2 and got[7].n_shingles == 1
    assert got[4].component_id == 3 and not got[4].kept and got[None].kept and got[None].component_id is None
    left = neardup.without_near_duplicates(edges)
    assert left.columns == edges.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [0, 1, 2, 3, 5, 6, 7]
    assert neardup.near_duplicates(nothing).count() == 0


def test_repeated_ids_of_unlike_texts(spark):
    """Each text of an id is a document: none is lost, and links of any of them count."""
    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    near = base[1].replace("b39", "zz")
    rows = [(1, base[0]), (1, base[1]), (2, near), (2, base[2]), (3, base[2]), (3, base[2]), (4, "one of a kind, of some words"), (4, "another of a kind, of some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (2, 2), (3, 2), (3, 2), (4, 4), (4, 4)]
    left = sorted(map(tuple, neardup.without_near_duplicates(df).collect()))
    assert left == sorted([(1, base[0]), (1, base[1]), (2, base[2]), (4, rows[6][1]), (4, rows[7][1])])


def test_sketch_estimates():
    rng = np.random.default_rng(5)
    for j in (0.5, 0.85, 0.95):
        n = 2000
        same_ = int(2 * n * j / (1 + j))
        a = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))[: 2 * n - same_]
        x, y = neardup.min_samples(a[:n]), neardup.min_samples(a[-n:])
        bits = int(np.bitwise_count(np.frombuffer(neardup.odd_sketch(x), np.uint8) ^ np.frombuffer(neardup.odd_sketch(y), np.uint8)).sum())
        assert abs(bits - neardup.differing_bits(j)) < 40


def test_components(spark):
    edges_ = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (200, 200)] + [(300, i) for i in range(301, 340)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges_, "a long, b long")).collect()))
    assert all(got[i] == 1 for i in range(1, 61)) and got[102] == 100 and 200 not in got and all(got[i] == 300 for i in range(300, 340))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9 line alignment


def test_patience():
    assert linedup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert linedup.patience([1, 1, 2], [1, 2]) == [(0, 0), (2, 1)]
    assert linedup.patience([], [1]) == [] and linedup.patience([5, 6], [6, 5]) in ([(0, 1)], [(1, 0)])


def test_patience_against_brute_force():
    """Where no line repeats, as many lines are aligned as any alignment can; blocks are the neighbouring pairs, found here line by line."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = int(rng.integers(0, 14))
        a = rng.permutation(20)[:n].tolist()
        b = [int(x) if rng.random() < 0.8 else 100 + i for i, x in enumerate(a)]
        for _ in range(int(rng.integers(0, 3))):
            b.insert(int(rng.integers(0, len(b) + 1)), b.pop(int(rng.integers(0, len(b))))) if b else None
        most = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                most[i + 1, j + 1] = max(most[i, j + 1], most[i + 1, j], most[i, j] + (x == y))
        got = linedup.patience(a, b)
        assert len(got) == most[-1, -1] and all(a[i] == b[j] for i, j in got)
        assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))
        weight = rng.integers(1, 15, len(b)).tolist()
        to = dict((j, i) for i, j in got)
        same = lambda lo, hi: all(j in to and to[j] - to[lo] == j - lo for j in range(lo, hi))
        ranges = [(lo, hi) for lo in range(len(b)) for hi in range(lo + 1, len(b) + 1) if lo in to and same(lo, hi) and sum(weight[lo:hi]) >= 20]
        want = [(lo, hi) for lo, hi in ranges if not any((x, y) != (lo, hi) and x <= lo and y >= hi for x, y in ranges)]
        assert linedup.common_blocks(a, b, weight) == want


def test_lines(spark, texts, edges, nothing):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_lines(texts)
    for r in linedup.without_repeated_blocks(df).collect():
        b, gone = texts[r.doc_id].split("\n"), want[r.doc_id]
        assert (r.n_lines, r.n_deleted, r.text) == (len(b), len(gone), "\n".join(x for i, x in enumerate(b) if i not in gone))
    odd = linedup.without_repeated_blocks(edges.withColumnRenamed("node", "a.b")).collect()
    assert len(odd) == edges.count() and {r.doc_id: r.n_lines for r in odd}[0] == 0 and odd[0]["a.b"] == 1
    assert linedup.without_repeated_blocks(nothing).count() == 0


def test_lines_of_repeated_ids(spark):
    """Texts of one id are documents of their own: each loses what an earlier id has, and nothing else."""
    long = "\n".join(f"line {i} of a text with some words" for i in range(8))
    other = "keep one\nkeep two\nkeep three\nkeep four"
    rows = [(1, long), (2, long), (2, other), (2, other + "\n" + long), (2, other), (3, long + "\nits own end"), (None, long), (2, None)]
    got = sorted(((r.doc_id, r.text) for r in linedup.without_repeated_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, long), (2, ""), (2, other), (2, other), (2, other), (3, "its own end"), (None, long), (2, None)], key=str)


def plain_patience(a, b, i=0, k=0):
    """Patience diff from its definition, from both ends inwards and then between lines that are unique in both."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, k), *plain_patience(a[1:], b[1:], i + 1, k + 1)]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1], i, k), (i + len(a) - 1, k + len(b) - 1)]
    both = [(a.index(x), j) for j, x in enumerate(b) if b.count(x) == 1 and a.count(x) == 1]
    ends = []  # the longest rising chain that ends in each, by looking at all before it
    for n, (x, _) in enumerate(both):
        ends.append(max((ends[m] for m in range(n) if both[m][0] < x), key=len, default=[]) + [both[n]])
    chain = max(ends, key=len, default=[])
    if not chain:
        return []
    out, p, r = [], 0, 0
    for x, y in [*chain, (len(a), len(b))]:
        out += [*plain_patience(a[p:x], b[r:y], i + p, k + r), *([(i + x, k + y)] if x < len(a) else [])]
        p, r = x + 1, y + 1
    return out


def plain_blocks(a, b, words):
    """Ranges of b's lines aligned with neighbours in a, of 20 words or more."""
    to = {k: i for i, k in plain_patience(a, b)}
    out, lo = [], 0
    for k in range(1, len(b) + 1):
        if k == len(b) or k - 1 not in to or to.get(k) != to[k - 1] + 1:
            if lo in to and sum(words[lo:k]) >= 20:
                out.append((lo, k))
            lo = k
    return out


def plain_lines(texts):
    """Each document's lines that an alignment with any earlier document deletes."""
    split = {k: t.split("\n") for k, t in texts.items()}
    n = {k: [len(x.encode().split()) for x in b] for k, b in split.items()}
    shares = lambda a, b: sum(w for x, w in zip(split[b], n[b], strict=True) if x in split[a]) >= 20
    return {k: {i for a in split if a < k and shares(a, k) for lo, hi in plain_blocks(split[a], b, n[k]) for i in range(lo, hi)} for k, b in split.items()}


def test_lines_of_all_earlier_documents(spark, texts):
    x, y = "one two three four five six seven eight nine ten", "b c d e f g h i j k"
    short = [f"s{i} t{i}" for i in range(12)]
    long = " ".join(f"w{i}" for i in range(25))
    made = [
        x,
        y,
        f"p\n{x}\n{y}\nq",
        f"r\n{x}\n{y}\ns",
        "\n".join(["u", *short]),
        "\n".join([*short, "v"]),
        # the first document of the line has it in another order than the second
        "\n".join([long, *short[:4], "z"]),
        "\n".join([long + " y", "z"]),
        "\n".join([*short[:4], long, "z"]),
        "\n".join([*short[:4], long]),
    ]
    all_texts = {k: t for k, t in texts.items() if k < 120} | {10_000 + i: t for i, t in enumerate(made)}
    df = spark.createDataFrame(list(all_texts.items()), "doc_id long, text string")
    want = plain_lines(all_texts)
    assert want[10_003] == {1, 2} and want[10_005] == set(range(12))
    for r in linedup.without_repeated_blocks(df).collect():
        assert r.text == "\n".join(x for i, x in enumerate(all_texts[r.doc_id].split("\n")) if i not in want[r.doc_id])


# 10 language model


def test_scores(spark, sf, texts):
    got = {r.doc_id: r for r in lm.op10_context_mixing(spark, sf).collect()}
    toks = {k: [*words(t), None] for k, t in texts.items()}
    c = collections.Counter(w for k, ws in toks.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in toks.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -6


def small_model(seed=1, n=40):
    rng = np.random.default_rng(seed)
    m = mixer.Model(mixer.Codes(np.append(np.sort(rng.integers(2, 900, n))[::-1], [30, 50])), rng.integers(0, 1 << 16, (2, 1 << 10)).astype(np.uint16))
    m.weights += rng.normal(0, 0.2, m.weights.shape)
    m.seen = rng.integers(0, 500, m.seen.shape).astype(float)
    m.hit = m.seen * rng.random(m.seen.shape)
    return m.ready()


@pytest.mark.parametrize("predicted", [mixer.NONE, 3, mixer.RARE + 5])
def test_probabilities_add_up(predicted):
    """Over all words of the vocabulary, the escape and the end, whatever is predicted; and letters over all bytes."""
    m, n = small_model(), 42
    ids = np.concatenate([[7, 2, w] for w in range(n)])
    t = mixer.Tokens(ids.astype(np.int32), np.arange(0, 3 * n, 3), np.tile([mixer.NONE, mixer.NONE, predicted], n).astype(np.int32), np.zeros(3 * n, np.int8), m.escape)
    assert math.isclose((10 ** m.log10(t, np.zeros(0))[2::3]).sum(), 1, rel_tol=1e-4)
    costs = mixer.letter_costs(np.random.default_rng(2).integers(0, 3, mixer.CLASSES**2 * 256))
    assert np.allclose((10.0**costs).sum(1), 1, atol=1e-4)


def test_counters_against_brute_force():
    """Counts of bits by slot, of the mix, and costs: each token by itself, in plain Python."""
    m = small_model()
    rng = np.random.default_rng(5)
    ids, first = rng.integers(0, 42, 300).astype(np.int32), np.array([0, 90, 91, 250])
    _, topic, previous = mixer.pairs(ids.astype(np.int64), first)
    got = np.zeros(2 << 10, np.int64)
    m.counted(ids.astype(np.int64), mixer.contexts(topic, previous)[1], np.ones(300, np.int64), got)
    want = collections.Counter()
    predicted = np.where(rng.random(300) < 0.3, ids, mixer.NONE).astype(np.int32)
    learned = (rng.random(300) < 0.5).astype(np.int8)
    t = mixer.Tokens(ids, first, predicted, learned, m.escape)
    logs = m.log10(t, np.zeros(0))
    table = m.costs().reshape(2, mixer.GATES, mixer.BINS)
    run, missed = 0, False
    for i, w in enumerate(ids.tolist()):
        start = max(f for f in first.tolist() if f <= i)
        if i == start:
            run, missed = 0, False
        before = mixer.PREVS + 1 if i == start else min(int(ids[i - 1]), mixer.PREVS)
        about = min([mixer.TOPICS, *(int(x) for x in ids[max(start, i - mixer.BACK) : i])])
        assert (topic[i], previous[i]) == (about, before)
        state = 0 if predicted[i] == mixer.NONE else 5 if missed else 1 + sum(run >= k for k in (1, 4, 16))
        total, on = 0.0, True
        for k in range(m.codes.size[w]):
            node, bit = int(m.codes.node[m.codes.start[w] + k]), int(m.codes.bit[m.codes.start[w] + k])
            x, gate = [], 0
            for j, c in enumerate(mixer.contexts(np.array([about]), np.array([before]))):
                slot = int((c[0] ^ m.mix[node]) >> m.shift)
                if j == 1:
                    want[2 * slot + bit] += 1
                z, o = mixer.COUNT[m.tables[j, slot] >> 8], mixer.COUNT[m.tables[j, slot] & 255]
                own = bool(learned[i])
                z, o = z - (own and not bit), o - (own and bit)
                x.append(math.log((max(o, 0) + mixer.PRIOR) / (max(z, 0) + mixer.PRIOR)))
                gate = gate * 3 + (z + o >= 0.5) + (z + o >= 20.5)
            z, o = m.codes.zeros[node] - (own and not bit), m.codes.ones[node] - (own and bit)
            x.insert(0, math.log((max(o, 0) + mixer.PRIOR) / (max(z, 0) + mixer.PRIOR)))
            p = predicted[i]
            match = 0
            if p != mixer.NONE and k < m.codes.size[p] and on and m.codes.node[m.codes.start[p] + k] == node:
                match = 2 * int(m.codes.bit[m.codes.start[p] + k]) - 1
                gate += state * 9
            x += [match, 1]
            mix = float(np.clip(sum(a * b for a, b in zip(m.weights[gate], x, strict=True)), -20, 20))
            total += table[bit, gate, int(np.clip((mix + mixer.FAR) * mixer.BINS / (2 * mixer.FAR), 0, mixer.BINS - 1))]
        assert abs(total - logs[i]) < 0.05 * max(1, m.codes.size[w] / 4), (i, total, logs[i])
        run = run + 1 if predicted[i] == w else 0
        missed = predicted[i] != mixer.NONE and predicted[i] != w
    assert {k: int(got[k]) for k in np.flatnonzero(got)} == dict(want)


def test_lessons_take_common_bits_once(monkeypatch):
    """As often as all tokens have them: what is learned is what each token teaches by itself, from fewer bits."""
    m, rng, looked_up = small_model(), np.random.default_rng(6), []
    ids, first = np.minimum(rng.zipf(1.5, 900), 42).astype(np.int32) - 1, np.array([0, 200, 201, 640])
    predicted = np.where(rng.random(900) < 0.5, np.where(rng.random(900) < 0.7, ids, rng.integers(0, 42, 900)), mixer.NONE).astype(np.int32)
    learned = np.ones(900, np.int8)
    plain = mixer.Tokens(ids, first, predicted, learned, m.escape)
    bit, x, gate, n = m.inputs(plain, slice(0, len(plain)))
    times, z, rows = np.repeat(plain.times, n), m.mixed(x, gate), np.stack([*x, np.ones(len(bit))])
    p = 1 / (1 + np.exp(-z.astype(float)))
    inputs = m.inputs
    monkeypatch.setattr(m, "inputs", lambda *a: looked_up.append(inputs(*a)) or looked_up[-1])
    lesson = mixer.Lesson(m)
    lesson.learn(mixer.Tokens(ids, first, predicted, learned, m.escape, m.codes, True))
    assert sum(len(b) for b, *_ in looked_up) < 0.8 * len(bit)
    for g in range(mixer.GATES):
        on = gate == g
        assert np.allclose(lesson.curve[g], np.eye(mixer.INPUTS) * 4 + (rows[:, on] * (p * (1 - p) * times)[on]) @ rows[:, on].T, rtol=1e-4, atol=1e-3)
        assert math.isclose(lesson.seen.reshape(mixer.GATES, -1)[g].sum(), times[on].sum()) and math.isclose(lesson.hit.reshape(mixer.GATES, -1)[g].sum(), (bit * times)[on].sum())
    whole = m.log10(plain, np.zeros(0))
    monkeypatch.setattr(mixer, "BLOCK", 16)
    assert np.allclose(m.log10(mixer.Tokens(ids, first, predicted, learned, m.escape, m.codes), np.zeros(0)), whole, atol=1e-4)


def test_counters_of_near_nodes_are_together():
    """A context's counters of four levels of the tree are in 16 slots beside each other, each in its own."""
    m = small_model()
    for symbol in range(42):
        node = m.path(np.array([symbol]))[0]
        slot = ((np.uint64(0x0123456789ABCDEF) ^ m.mix[node]) >> m.shift).astype(int)
        assert all(len(set((slot[k : k + 4] // 16).tolist())) == 1 and len(set(slot[k : k + 4].tolist())) == len(slot[k : k + 4]) for k in range(0, len(slot), 4))


def test_scores_repeat(spark):
    """More tasks than workers, and other tasks: the same scores, as all that is added are whole numbers."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, 60))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in rows[:40]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = lm.F.col("doc_id") % 5 != 0
    got = [{r.doc_id: r.score for r in lm.lm_scores(df.repartition(n), learn).collect()} for n in (3, 9)]
    assert got[0] == pytest.approx(got[1], rel=1e-6)
    twice = [got[0][i] for i in range(40)]
    once = [got[0][i] for i in range(40, 400)]
    assert np.median(twice) > np.median(once)


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(mixer, "PIECE", 10)
    starts, bounds = mixer.groups(np.array([0, 25, 25, 31, 60]), 20)
    assert starts.tolist() == [0, 10, 20, 25, 25, 31, 41, 51, 60]
    assert bounds[0] == 0 and bounds[-1] == len(starts) - 1 and all(starts[b] - starts[a] <= 20 for a, b in zip(bounds, bounds[1:]))
    monkeypatch.setattr(common, "CHUNK_BYTES", 8)
    data, offs = common.flat(pa.array([b"one three  fifteen-letters x", b"", b"one"]))
    s, e, _ = common.word_bounds(data, offs, common.BLANK_WORD)
    h = common.word_hashes(data, s, e)
    assert h[0] == h[-1] and h.tolist() == common.hash_words([b"one", b"three", b"fifteen-letters", b"x", b"one"]).tolist()


def test_score_edges(spark, edges, nothing):
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in lm.lm_scores(edges, F.lit(True)).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 1 and got[0].score == got[2].score < 0 and got[6].n_tokens == 30_001
    assert lm.lm_scores(nothing, F.lit(True)).count() == 0
    blank = lm.lm_scores(edges, F.lit(False)).collect()
    assert len(blank) == edges.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in blank)


# pipeline


def test_pipeline(spark, sf, texts, library):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_ids"] and p.ORACLE_SQL is None
    out = p.run(spark, sf).orderBy("start").collect()
    assert out and [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out]).tolist()[:-1]]
    want = plain_pipeline(sf, texts, library)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out] == want


def test_results_of_one_stage(spark, docs, sf):
    """Both can be read, also after a stage that takes one of them unwritten."""
    import corpus_pipeline as p

    a, b = (p.rules(spark, docs.where(f"doc_id % 2 = {k}"), sf) for k in (0, 1))
    chained = p.clean(spark, a, sf)
    assert b.count() > 0 and a.count() >= chained.count() > 0
    first = {k: len(v) for k, v in common._left.items()}
    p.clean(spark, docs, sf)
    assert all(len(v) <= first[k] for k, v in common._left.items())


def test_pipeline_on_nothing(spark, docs, sf, tmp_path):
    import shutil

    import corpus_pipeline as p

    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{sf}/benchmark.parquet", tmp_path / "benchmark.parquet")
    out = p.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 0


def test_first_tier_answers(spark, texts, library):
    """After the pass that counts, a worker's encoder answers frequent pre-tokens from the broadcast table alone, whatever other encoders the worker has."""
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    binary.round_trip(df, VOCAB).count()
    ready = token_counts.frequent(df, VOCAB)
    top = collections.Counter(w for t in texts.values() for w in t.lower().split() if w.isalpha()).most_common(20)
    enc = tokens.encoder(VOCAB, "test", ready)
    held = enc.words
    assert held == len(ready[0]) > 1000
    assert enc.counts(pa.array([" ".join(w for w, _ in top)])).tolist() == [len(library.encode(" ".join(w for w, _ in top), add_special_tokens=False).ids)] and enc.words == held
    assert tokens.encoder(VOCAB, "test", None) is enc and tokens.encoder(VOCAB, "vocabulary", None) is not enc

    from pyspark.sql import functions as F

    def told(batches):
        for batch in batches:
            for name, enc in list(tokens._encoders.values()):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([enc.ready is not None])], names=["name", "ready"])

    out = token_counts.token_counts(df, VOCAB)
    assert out.agg(F.sum("n_tokens")).first()[0] == sum(len(library.encode(t, add_special_tokens=False).ids) for t in texts.values())
    seen = {(r.name, r.ready) for r in common.map_arrow(df, told, "name string, ready boolean").collect()}
    assert any(ready and name != "vocabulary" for name, ready in seen)


def plain_clean(text, grams):
    """The text with spans of words of any item's window cut out; None where more than half of its words are hit."""
    first = True
    while True:
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER)))
        w = [m.group() for m in found]
        hit = {j for n in {len(g) for g in grams} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for j in range(i, i + n)}
        if first and 2 * len(hit) > len(w):
            return None
        if not hit:
            return text
        first, starts = False, sorted(i for i in hit if i - 1 not in hit)
        for i in reversed(starts):
            j = next(j for j in range(i, len(w) + 1) if j not in hit) - 1
            text = text[: found[i].start()] + "\n" + text[found[j].end() :]


def plain_targets(sizes, most=3):
    """Shares by weight 1, 2, 3, a source at a time held to its cap, until none is above it."""
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped, total = {}, sum(sizes.values())
    while True:
        left = total - sum(capped.values())
        free = sum(w for s, w in weight.items() if s not in capped)
        share = {s: w * left / free for s, w in weight.items() if s not in capped}
        above = {s: most * sizes[s] for s, x in share.items() if x > most * sizes[s]}
        if not above:
            return share | capped
        capped |= above


def plain_pipeline(sf, texts, library):
    """The five stages in plain Python; only the verdict of the rules is taken from SQL, whose fit test_least_determinant holds against a search."""
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    kept = {k: texts[k] for k, keep in con.execute(f"SELECT doc_id, kept FROM ({quality_rules.OP2_SQL})").fetchall() if keep}
    roots = {k: kept[k] for k, (_, root) in plain_components(kept, 80).items() if k == root}
    items = [words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    grams = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    clean = {k: t for k, t in ((k, plain_clean(t, grams)) for k, t in roots.items()) if t is not None}
    assert len(texts) > len(kept) > len(roots) and clean != roots
    source = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    size = {k: len(words(t)) for k, t in clean.items()}
    total = collections.Counter()
    for k, n in size.items():
        total[source[k]] += n
    target = plain_targets(total)
    upto, queue = collections.Counter(), []
    for k in sorted(clean, key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k)):
        upto[source[k]] += size[k]
        queue += [((i * total[source[k]] + upto[source[k]]) / target[source[k]], k) for i in range(3) if size[k]]
    copies, used = collections.Counter(), 0
    for _, k in sorted(queue):
        used += size[k]
        if used > sum(size.values()):
            break
        copies[k] += 1
    out, start = [], 0
    for k in sorted(copies):
        ids = np.array([*library.encode(clean[k], add_special_tokens=False).ids, 2], "<u4")
        for _ in range(copies[k]):
            out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    return out


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
