"""The corpus pipeline against brute force of each stage, on planted documents and odd rows."""

import itertools
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from plantmill.llm import language, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OWN = {"en": "the and of with stone thing which house under river while they walk by old trees", "de": "der und von mit stein ding welches haus unter fluss bis alle gehen durch alte baum"}


def prose(rng, lang, n):
    """Words of a language with endings, so that two texts share few runs of five."""
    return " ".join(rng.choice(OWN[lang].split()) + rng.choice(["", "", "", "s", "n", "ed", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(21), tmp_path_factory.mktemp("sf")
    passages = [" ".join(f"question{k}x{i}" for i in range(14)) for k in range(3)]
    texts = [(k, prose(rng, "en" if k % 2 else "de", rng.randint(40, 160)), "en" if k % 2 else "de") for k in range(160)]
    texts += [(200 + k, texts[k][1], texts[k][2]) for k in range(12)]  # exact copies
    for k in range(12):  # near copies: one word of many is another
        words = texts[20 + k][1].split()
        words[len(words) // 2] = "otherwise"
        texts.append((300 + k, " ".join(words), texts[20 + k][2]))
    for k in range(9):  # a passage of the benchmark inside
        a, b = prose(rng, "en", 30), prose(rng, "en", 30)
        texts.append((400 + k, f"{a} {passages[k % 3].upper()} {b}", "en"))
    texts += [(500, None, "en"), (501, "", None), (502, "the and of", "en"), (503, "same same same same same " * 40, "en"), (504, "!?# " * 60, None)]
    texts += [texts[3], texts[3], (None, texts[5][1], "de")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in texts], SCHEMA).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def brute_groups(rows):
    """The first of each group that similarity 0.8 of five-word shingles connects; rows without a doc_id stay."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (re.sub("[A-Z]", lambda m: m.group().lower(), t or "").split() for _, t in rows)]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in itertools.combinations([k for k, (i, _) in enumerate(rows) if i is not None], 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)), key=lambda k: (rows[k][0], k))
            top[y] = x
    return [rows[k] for k in range(len(rows)) if find(k) == k]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    passages = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_duplicates", "benchmark_passages", "sentencepiece_ids"]
    good = corpus_pipeline.quality_rules(spark, docs, folder)
    judged = docs.join(quality.judge(docs).where("kept").select("doc_id").distinct(), "doc_id", "left_semi")
    assert good.columns == docs.columns and rows_of(good.where("doc_id is not null")) == rows_of(judged)
    gone = {500, 501, 502, 503, 504}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in good.collect()} == gone and good.where("doc_id is null").count() == 1
    named = corpus_pipeline.language_id(spark, good, folder)
    assert named.columns == docs.columns and named.where("doc_id < 300 or doc_id is null").count() == good.where("doc_id < 300 or doc_id is null").count()
    predicted = {r.doc_id: r.lang_pred for r in language.identify(good, language.train(good)).collect()}
    assert all(predicted[r.doc_id] == r.lang for r in good.where("doc_id < 160").collect())
    before = rows_of(named)
    single = corpus_pipeline.near_duplicates(spark, named, folder)
    assert single.columns == docs.columns and rows_of(single) == sorted(brute_groups(before), key=repr)
    clean = corpus_pipeline.benchmark_passages(spark, single, folder)
    cut = lambda t: re.sub("|".join(map(re.escape, passages)), "", t, flags=re.I)
    assert clean.columns == docs.columns and rows_of(clean) == sorted(((i, cut(t)) for i, t in rows_of(single)), key=repr)
    ids = corpus_pipeline.sentencepiece_ids(spark, clean, folder)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(((r.doc_id, r.ids) for r in ids.collect()), key=repr) == sorted(((i, model.encode(t)) for i, t in rows_of(clean)), key=repr)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, ids.collect()))


def test_stages_on_odd_rows(spark, folder):
    """Empty tables give no row; only nulls and empty texts leave nothing behind the first stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for rows in (docs.limit(0), docs.where("doc_id in (500, 501)").withColumn("lang", F.lit(None).cast("string"))):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, folder)
            assert rows.count() == 0
