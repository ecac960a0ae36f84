"""Quality rules: fixed limits, and the divergence of a document's histograms from its language's.

Two histograms describe a document: its characters by class, and its words by common word. A language's reference
is the sum over all its documents, so the rules learn from the whole corpus and not from a list of scores. A document is
kept unless the fixed rules fail or the Jensen-Shannon distance of a histogram from its language's is too large. Short
documents have noisy histograms, so a guard of least length stands before each comparison; languages with too few
documents judge nothing. All of it is DataFrame functions.

The word histogram has a class for the words that are not listed, so a text that misses its language's common words is far
from it; its guard is the number of common words that a document of this length should have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmill.llm.common import SPACE, ascii_words, cut, let, new_folder

# Frequent function words of the languages served.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not this are from",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas plus",
    "es": "de la que el en y los se del las un por con una no es para al lo como",
}
WORDS = sorted({w for line in COMMON.values() for w in line.split()})
LONGEST = max(len(w.encode()) for w in WORDS)
# Character classes; what none of them has, lower-case letters most of all, is the class "other".
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r".,;:!?", "symbol": r"#*$%&|<>", "space": SPACE}
REPEAT = 5


@dataclass(frozen=True)
class Rules:
    least_words: int = 10
    most_repeat_percent: int = 20
    class_distance: float = 0.45
    missing_share: float = 0.8  # largest word distance, as a share of the one that a text without any common word has
    least_chars: int = 100  # guard of the class histogram
    least_common: int = 30  # guard of the word histogram: common words that a document of this length should have
    least_docs: int = 20  # guard of a reference


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of 5 words found twice or more in the text."""
    n = F.size(words)
    window = lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(REPEAT)))
    hashes = F.transform(F.sequence(F.lit(0), n - REPEAT), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(REPEAT))))

    def count(h: Column) -> Column:
        exact = F.array_sort(F.transform(F.sequence(F.lit(0), n - REPEAT), lambda i: F.struct(window(i).alias("w"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["w"] == F.get(s, j)["w"], F.lit(False))
            order = F.sequence(F.lit(0), F.size(s) - 1)
            found = F.array_sort(F.transform(F.filter(order, lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(s, i)["i"]))
            total = lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(REPEAT), F.coalesce(F.get(at, k + 1) - p, F.lit(REPEAT)))), F.lit(0), lambda a, x: a + x)
            return let(found, total)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(exact, covered))

    return F.when(n < REPEAT, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def features(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carry`, base counts and the two histograms, one row per row of docs, all from the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(*carry, F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"), ascii_words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    without = lambda c: F.length("text") - F.length(F.regexp_replace("text", f"[{c}]+", ""))
    listed = F.array(*(F.lit(w) for w in WORDS))
    short = F.filter("words", lambda w: F.octet_length(w) <= LONGEST)
    common = F.filter(F.transform(short, lambda w: F.array_position(listed, F.lower(w)).cast("int")), lambda k: k > 0)
    tally = let(common, lambda c: F.array(*(F.size(c) - F.size(F.array_remove(c, F.lit(k + 1))) for k in range(len(WORDS)))))
    counted = own.select(
        *carry, "lang", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(CLASSES["symbol"]).cast("long").alias("n_symbols"),
        F.length("text").alias("n_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        tally.alias("word_counts"),
    )
    # White space is what no word holds, and symbols are counted already.
    known = {"space": F.col("n_chars") - F.col("word_chars"), "symbol": F.col("n_symbols")}
    classes = F.array(*((known[k] if k in known else without(c)).cast("int") for k, c in CLASSES.items()))
    n_common = F.aggregate("word_counts", F.lit(0), lambda a, x: a + x)
    return counted.withColumns({"class_counts": classes, "n_common": n_common}).drop("text", "words")


def references(rows: DataFrame, rules: Rules) -> DataFrame:
    """lang, ref_classes, ref_words: the shares of each language's summed histograms, with the rest as the last one; tiny, one row per language."""
    n, m = len(CLASSES), len(WORDS)
    total = lambda c, n: [F.sum(F.get(c, F.lit(k))).alias(f"{c}_{k}") for k in range(n)]
    out = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.sum("n_words").alias("n_all"), *total("class_counts", n), *total("word_counts", m))
    part = lambda c, k, of: F.array(*(F.col(f"{c}_{i}") / of for i in range(k)))
    some = lambda of: F.when(F.col(of) > 0, F.col(of))
    return out.where(F.col("docs") >= rules.least_docs).select("lang", with_rest(part("class_counts", n, some("chars"))).alias("ref_classes"), with_rest(part("word_counts", m, some("n_all"))).alias("ref_words"))


def with_rest(shares: Column) -> Column:
    """Shares and what is left of 1."""
    return F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence to base 2: 0 to 1."""
    term = lambda x, y: F.when(x > 0, x * F.log2(F.lit(2.0) * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: term(x, y) + term(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def _judged(rows: DataFrame, rules: Rules) -> DataFrame:
    """rows of `features` with base_failed, class_js, word_js, word_limit and kept."""
    refs = cut(references(rows, rules))
    n_words, m = F.col("n_words"), len(WORDS)
    class_js = js_distance(with_rest(F.transform("class_counts", lambda x: x / F.col("n_chars"))), F.col("ref_classes"))
    word_js = js_distance(with_rest(F.transform("word_counts", lambda x: x / n_words)), F.col("ref_words"))
    none_listed = F.transform("ref_words", lambda x, k: F.when(k == m, 1.0).otherwise(0.0))
    # The limit is the language's, not the document's.
    refs = refs.withColumns({"word_limit": rules.missing_share * js_distance(none_listed, F.col("ref_words")), "due_share": 1 - F.get("ref_words", F.lit(m))})
    out = rows.join(refs, "lang", "left").withColumns({
        "base_failed": (n_words < rules.least_words) | (F.col("n_repeat_words") * 100 > n_words * rules.most_repeat_percent),
        "class_js": F.when((F.col("n_chars") >= rules.least_chars) & F.col("ref_classes").isNotNull(), class_js),
        "word_js": F.when((n_words * F.col("due_share") >= rules.least_common) & F.col("ref_words").isNotNull(), word_js),
    })
    near = (F.coalesce("class_js", F.lit(0.0)) <= rules.class_distance) & F.coalesce(F.col("word_js") < F.col("word_limit"), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & near)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, base_failed, class_js, word_js, kept: one row per row of docs.

    Null text counts as empty: no words, so it fails the fixed rules. A null lang is a language of its own. Repeated rows
    are judged each; very long texts are counted whole; extra columns are ignored; an empty table gives no row. A distance is
    null where its guard bars it.
    """
    out = _judged(cut(features(docs)), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_js", "word_js", "kept")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that `judge` keeps; columns as given. Every row stands for itself, also those of one doc_id.

    Rows go to the shared folder once with their counts; the references, a row per language, come back to them, so no text is
    shuffled.
    """
    spark = docs.sparkSession
    own = next(c for c in map("_row{}".format, range(len(docs.columns) + 1)) if c not in docs.columns)
    whole = F.struct(*docs.columns).alias(own)
    folder = new_folder(spark, "counted")
    features(docs.select("text", "lang", whole), (own,)).write.parquet(folder)
    return _judged(spark.read.parquet(folder), rules).where("kept").select(*(F.col(own)[c].alias(c) for c in docs.columns))
