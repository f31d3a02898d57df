import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from readloom.llm import _common, _text, langid, quality, scoring, subword, toxicity

RNG = random.Random(2)
PLAIN = ["".join(RNG.choice("abcdefghilmnoprstu") for _ in range(RNG.randrange(2, 9))) for _ in range(500)]
BAD = ["grumbled", "snarkish", "vileword", "foultalk"]


def words(n):
    return [RNG.choice(PLAIN) for _ in range(n)]


def toxic_text(n):
    w = words(n)
    for _ in range(2 + n // 60):
        w[RNG.randrange(n)] = RNG.choice(BAD)
    return " ".join(w)


@pytest.fixture(scope="module")
def labelled():
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        junk = i % 7 == 0
        text = toxic_text(RNG.randrange(8, 200)) if toxic else " ".join(words(RNG.randrange(5, 200)))
        if junk:
            text = " ".join(x.upper() + "!!" for x in text.split())
        docs.append((i, text, "en", "s"))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return docs, labels


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_accuracy_and_odd_rows(spark, labelled, module):
    docs, labels = labelled
    odd = [(9001, None, None, None), (9002, "", "en", "s"), (None, "abc", None, None), (0, docs[0][1], "en", "s"), (9003, "zz " * 60_000, "en", "s")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as score", "'x' as label")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    scored = (quality.quality_scores if module is quality else toxicity.toxicity_scores)(df, lab)
    rows = scored.collect()
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id, module.FOLDS) == module.HELD_OUT) for r in rows)
    truth = {i: (q if module is quality else t) for i, q, t in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_keep_returns_the_rows_of_docs(spark, labelled):
    docs, labels = labelled
    df = spark.createDataFrame(docs[:60], "doc_id long, text string, lang string, source string").selectExpr("*", "1 as score", "doc_id % 2 as predicted")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    said = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(df, lab).collect()}
    for y in (0, 1):
        kept = toxicity.toxicity_scores(df, lab, keep=y)
        assert kept.columns == df.columns
        assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in df.collect() if said[r.doc_id] == y)


@pytest.mark.parametrize("keep", [0, 1])
def test_kept_texts_leave_in_small_batches(spark, monkeypatch, keep):
    """kept texts go back to Spark in slices, not in one batch as large as that they came in."""
    model = subword.Model(toxicity.SETTINGS, np.random.default_rng(3).normal(0, 1, 1 << toxicity.SETTINGS.bits).astype(np.float32), 0.5)
    monkeypatch.setattr(scoring, "fitted", lambda *_: model)

    class Docs:
        sparkSession, schema = spark, "doc_id long, text string"

        def mapInArrow(self, f, _):
            return f

    texts = [None, ""] + [" ".join(words(40)) for _ in range(6000)] + ["x" * (2 * _text.SLICE_BYTES), None, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = list(toxicity.toxicity_scores(Docs(), None, keep=keep)(iter([batch])))
    want = batch.filter(pa.array((subword.score(model, batch.column("text")) >= toxicity.THRESHOLD) == bool(keep)))
    assert 0 < want.num_rows < len(texts) and pa.Table.from_batches(out).to_pylist() == want.to_pylist()
    assert all(b.num_rows <= 1 or b.nbytes <= 1.2 * _text.SLICE_BYTES for b in out)


def test_label_samples_need_no_python_workers(spark, labelled, monkeypatch):
    """ids of a sample are no RDD of Python objects, for which each executor would start workers of another kind."""
    docs, labels = labelled
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def refuse(*_, **__):
        raise AssertionError("a list became an RDD")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    got = list(_common.labelled_texts(df, lab, "toxic", 3, 1, 1000, 1 << 24))
    want = [(x, t) for (i, x, *_), (_, _, t) in zip(docs, labels, strict=True) if crc(i, 3) != 1]
    assert got == want


def test_without_labels_or_docs(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality_scores(df, none).collect()] == [0.5]
    assert toxicity.toxicity_scores(df.limit(0), none).count() == 0


def test_misspellings_share_vectors():
    texts = [(toxic_text(40), 1) if i % 3 == 0 else (" ".join(words(40)), 0) for i in range(600)]
    model = subword.fit(toxicity.SETTINGS, texts)
    clean = " ".join(words(30))
    p = subword.score(model, pa.array([clean, clean + " snarkissh grummbled", clean + " foultalk vileword"]))
    assert p[0] < p[1] and p[0] < 0.3 < p[2]


def test_score_is_the_average_of_vectors():
    """The folded table gives what averaging vectors and a softmax give."""
    settings = subword.Settings(lower=True, alnum=True, bits=10)
    corpus = subword._Corpus(settings, [("ab cd cd efgh", 1), ("", 0)])
    trainer = subword._Trainer(settings, corpus)
    row = corpus.rows[0]
    feats = np.concatenate([corpus.feature[corpus.begin[t] : corpus.begin[t + 1]] for t in row])
    z = trainer.vectors[feats].mean(axis=0) @ trainer.soft
    model = subword.Model(settings, trainer.logits(), 0.0)
    assert np.allclose(subword.score(model, pa.array(["ab cd cd efgh"])), 1 / (1 + np.exp(z[0] - z[1])), atol=1e-5)


def test_passages_cover_every_word():
    for n in (0, 1, 15, 16, 17, 23, 24, 25, 100, 101):
        doc, a, b = subword._passages(np.array([n, 3]), 16)
        seen = {i for d, x, y in zip(doc, a, b, strict=True) if d == 0 for i in range(x, y)}
        assert seen == set(range(n))


def test_language_id(spark):
    alphabets = {"xx": "aeiounst", "yy": "äöüßkzwx", "zz": "каобвгде"}
    docs = []
    for i in range(450):
        name = list(alphabets)[i % 3]
        docs.append((i, " ".join("".join(RNG.choice(alphabets[name]) for _ in range(5)) for _ in range(RNG.randrange(1, 150))), name))
    odd = [(9001, None, "xx"), (9002, "", None), (9003, "12 34 !?", "yy"), (None, "aeiou", None), (0, docs[0][1], "xx"), (9004, "aeiou " * 40_000, None)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as lettered", "3 as lang_pred")
    rows = langid.languages(df).collect()
    assert len(rows) == len(docs) + len(odd)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (9001, 9002, 9003))
    assert by[9004].lang_pred == "xx"
    assert np.mean([by[i].lang_pred == lang for i, _, lang in docs if crc(i, 3) == 1]) > 0.97
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.languages(nothing).collect()] == ["und"]
    assert langid.languages(df.limit(0)).count() == 0


def test_folded_tables_equal_the_convolution():
    s = langid.Settings()
    trainer = langid._Trainer(s, 3)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    e = trainer.p["e"][x]
    pooled = []
    for w in langid.WIDTHS:
        cols = np.concatenate([e[:, j : langid.WINDOW - w + 1 + j] for j in range(w)], axis=2)
        pooled.append((cols @ trainer.p[f"k{w}"] + trainer.p[f"b{w}"]).max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1), 0) @ trainer.p["w"] + trainer.p["c"]
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(langid.windows_proba(langid._folded(trainer.p, ["a", "b", "c"], s), x), want, atol=1e-4)


def test_every_language_is_learnt(spark):
    """Many languages stored one after the other, and a text above the byte budget that comes first."""
    names = [f"l{k:02}" for k in range(12)]
    docs = [(0, "long " * 2000, "l00")] + [(1 + i, f"{name} word " * 20, name) for name in names for i in range(names.index(name) * 100, names.index(name) * 100 + 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1)
    settings = langid.Settings(rows=40, max_rows=60, max_bytes=60 * 3 * langid.WINDOW, windows=3)
    seen: dict[str, set] = {}
    for window, lang in langid.labelled(df, settings):
        assert 0 < len(window) <= langid.WINDOW
        seen.setdefault(lang, set()).add(window)
    assert sorted(seen) == names


def test_a_language_of_long_texts_is_learnt(spark):
    docs = [(i, ("aeiou " if i % 2 else "kzwx ") * 3000, "xx" if i % 2 else "yy") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = langid.languages(df, langid.Settings(max_bytes=12_000)).collect()
    assert all(r.lang_pred == ("xx" if r.doc_id % 2 else "yy") for r in rows)


@pytest.mark.parametrize("balanced", [False, True])
def test_long_labelled_texts_are_skipped(spark, balanced):
    texts = [(i, "x" * (5000 if i % 3 == 0 else 10), i % 2) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, y int")
    got = list(_common.labelled_texts(docs, docs, "y", 3, 1, 60, 1000, balanced))
    short = [(t, y) for i, t, y in texts if len(t) == 10 and crc(i, 3) != 1]
    assert sorted(got) == sorted(short)


def test_labels_share_the_bytes():
    found = [(i, 0, 100) for i in range(100)] + [(100 + i, 1, 100) for i in range(3)]
    taken = _common.within(found, 1000)
    assert [y for _, y in taken].count(1) == 3 and [y for _, y in taken].count(0) == 7


def test_an_unusable_label_is_an_error(spark):
    docs = spark.createDataFrame([(i, "x" * 2000, i % 2) for i in range(9)], "doc_id long, text string, y int")
    with pytest.raises(ValueError, match="fits into 1000 bytes"):
        list(_common.labelled_texts(docs, docs, "y", 3, 1, 60, 1000))
    assert list(_common.labelled_texts(docs.limit(0), docs, "y", 3, 1, 60, 1000)) == []


def test_rare_languages_are_learnt(spark):
    """More languages than the sample has rows: each still has one."""
    docs = [(i, f"x{i % 300} y{i % 300}", f"l{i % 300:03}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    seen = [lang for _, lang in langid.labelled(df, langid.Settings(max_rows=50, windows=1))]
    assert sorted(seen) == [f"l{k:03}" for k in range(300)]


def test_results_do_not_depend_on_the_layout(spark, labelled):
    """Two and five partitions, with a labelled text that is larger than the whole sample may be."""
    docs, labels = labelled
    langs = [(i, t, ("aa", "bb")[i % 2]) for i, t, _, _ in docs]
    langs.insert(0, (0, "vast words " * 2_400_000, "aa"))
    df = spark.createDataFrame(langs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    makers = [
        (langid.languages, lambda r: (r.doc_id or 0, r.lang_pred, round(r.score, 5))),
        (lambda d: quality.quality_scores(d, lab), lambda r: (r.doc_id or 0, r.predicted, round(r.score, 5))),
        (lambda d: toxicity.toxicity_scores(d, lab), lambda r: (r.doc_id or 0, r.predicted, round(r.score, 5))),
    ]
    for make, row in makers:
        two, five = (sorted(map(row, make(df.repartition(n)).collect())) for n in (2, 5))
        assert two == five
        assert len({x[2] for x in two}) > 100  # no constant


def test_the_worst_passage_counts():
    """A document's score is that of its worst passage, by vectors and softmax without folding."""
    settings = toxicity.SETTINGS
    texts = [(toxic_text(40), 1) if i % 3 == 0 else (" ".join(words(40)), 0) for i in range(200)]
    model = subword.fit(settings, texts)
    plain = subword.Model(subword.Settings(lower=True, alnum=True), model.logits, model.bias)
    for n in (1, 3, 4, 5, 6, 7, 23, 60):
        w = [f"{x}{i}" for i, x in enumerate(toxic_text(n).split())]
        ends = [*range(settings.window, n, settings.window // 2), n]
        passages = [" ".join(w[max(0, e - settings.window) : e]) for e in ends]
        assert subword.score(model, pa.array([" ".join(w)]))[0] == pytest.approx(subword.score(plain, pa.array(passages)).max(), abs=1e-5)
