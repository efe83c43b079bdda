"""Every operator and stage on tables with nulls, empty and very long texts, repeated rows, clashing columns, and none."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reachlight.llm import bpe, language, lengths, media, neardup, packing, pii, repetition, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, keep boolean, TEXT string, c1 string, pack long, tokens int, language string, jaccard double, block long, k string, u long, size long"
WORDS = "the river runs over green hills and every stone tells an old story of rain wind and light upon quiet water while birds sing"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


def rows():
    def row(doc_id, text, lang="en", source="a"):
        return (doc_id, text, lang, source, None if text is None else len(text), 7, False, "other", "c", 1, 2, "xx", 0.5, 3, "k", 4, 5)

    out = [row(i, f"{WORDS} number{i} item{i * 7}") for i in range(6)]
    out += [row(10, None), row(11, ""), row(12, "   \n\t "), row(13, LONG), row(None, WORDS), row(14, WORDS, None, None), row(15, WORDS, "en", "a"), row(15, WORDS, "en", "a")]
    out += [row(16, "same bit here " * 60), row(17, "\u0000 ퟿ 漢字 👍"), (None,) * 17, row(18, "le fleuve passe sous les collines vertes et la pierre raconte", "fr"), row(19, "mail me at ann.12@mail3.example.com or +1 (499) 555-6503 now please")]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(6)] + [(None, 1, 1), (10, None, None), (15, 1, 0), (15, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def small_pii():
    return pii.fit([WORDS], steps=3)


def operators(labels, small_pii):
    return {
        "media": lambda d: media.fingerprints(media.rendered(d)),
        "repetition": repetition.measures,
        "clean": repetition.clean,
        "packing": packing.pack,
        "lengths": lambda d: lengths.histogram(lengths.encoded_lengths(d)),
        "neardup": neardup.similar,
        "deduplicated": neardup.deduplicated,
        "language": lambda d: language.identified(d, language.train(d)),
        "known": lambda d: language.known(d, language.train(d)),
        "bpe": bpe.encoded,
        "decoded": lambda d: bpe.decoded(bpe.encoded(d)),
        "pii": lambda d: pii.searched(d, small_pii),
        "redacted": lambda d: pii.redacted(d, small_pii),
        "toxicity": lambda d: toxicity.scored(d, toxicity.train(d, labels)),
        "sharding": sharding.shard,
    }


NAMES = ["media", "repetition", "clean", "packing", "lengths", "neardup", "deduplicated", "language", "known", "bpe", "decoded", "pii", "redacted", "toxicity", "sharding"]
ROW_FOR_ROW = {"media", "repetition", "language", "bpe", "decoded", "pii", "redacted", "toxicity", "sharding"}


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(table, none, labels, small_pii, name):
    run = operators(labels, small_pii)[name]
    got = run(table).collect()
    assert got
    if name in ROW_FOR_ROW:
        assert len(got) == len(rows())
    assert run(none).collect() == []


@pytest.mark.parametrize("name", ["clean", "deduplicated", "known", "redacted"])
def test_columns_stay(table, labels, small_pii, name):
    out = operators(labels, small_pii)[name](table)
    assert out.columns == table.columns
    assert [f.dataType for f in out.schema] == [f.dataType for f in table.schema]
    other = {tuple(r)[2:] for r in table.select(*[F.col(f"`{c}`") for c in table.columns if c.lower() != "text"]).collect()}
    assert {tuple(v for c, v in zip(out.columns, r) if c.lower() != "text")[2:] for r in out.collect()} <= other


def test_defined_results(table, labels, small_pii):
    ops = operators(labels, small_pii)
    m = {r.doc_id: r for r in ops["repetition"](table).collect()}
    assert m[10].covered is None and m[11].covered == 0 and m[16].covered > 0.9 and m[13].covered == 0
    kept = [r.doc_id for r in ops["clean"](table).select("doc_id").collect()]
    assert 16 not in kept and 10 not in kept and 11 in kept and kept.count(15) == 2
    b = {r.doc_id: r for r in ops["bpe"](table).collect()}
    assert b[10].ids is None and b[11].ids == [] and all(r.exact for r in b.values() if r.ids is not None)
    f = {r.doc_id: r for r in ops["media"](table).collect()}
    assert f[10].times is None and f[10].error is None and f[11].samples == 0 and f[11].times == []
    lang = {r.doc_id: r for r in ops["language"](table).collect()}
    assert lang[10].language is None and lang[12].share == 0 and lang[0].language == "en"
    tox = {r.doc_id: r for r in ops["toxicity"](table).collect()}
    assert tox[10].probability is None and tox[11].probability is not None
    known = [r.doc_id for r in ops["known"](table).select("doc_id").collect()]
    assert 10 not in known and 11 not in known and 12 not in known and 0 in known
    pairs = {(r.doc_a, r.doc_b): r.jaccard for r in ops["neardup"](table).collect()}
    assert (14, 15) in pairs and pairs[14, 15] == 1 and all(a < b for a, b in pairs)
    stay = [r.doc_id for r in ops["deduplicated"](table).select("doc_id").collect()]
    assert stay.count(None) == 2 and 15 not in stay and 0 in stay


def test_sharding_adds_a_free_name(table):
    out = sharding.shard(table, target=2000)
    assert out.columns == [*table.columns, "shard_"]
    assert sorted(map(str, out.drop("shard_").collect())) == sorted(map(str, table.collect()))


def test_stages(spark, table, none, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 3)
    monkeypatch.setattr(pii, "train", lambda d: pii.fit([WORDS], steps=3))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "PII", "packing"]
    for start in (table, none):
        docs = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, docs, "")
            if i < 4:
                assert after.columns == docs.columns
            docs = spark.createDataFrame(after.collect(), after.schema)
    assert docs.columns == ["pack", "slot", "offset", "doc_id", "start", "tokens"]


def test_run_is_the_stages_one_after_the_other(spark, folder, monkeypatch):
    monkeypatch.setattr(pii, "train", lambda d: pii.fit([WORDS], steps=3))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        docs = stage(spark, docs, folder)
    key = lambda r: (r.doc_id, r.start, r.tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, docs.collect()))
