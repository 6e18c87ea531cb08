"""Quality rules: base counts of a text, and the divergence of its histograms from those of its language.

Everything is DataFrame work. A text has two histograms: characters by class, and words by common word of its language
(a bin each, and one for all others). Each is compared with that of the language, summed over all documents of at least
`MIN_WORDS` words, by Jensen-Shannon distance (base 2, so 0 to 1). Short texts are guarded: too few characters or words
for a histogram mean that it isn't compared.

Null, empty and blank texts have no words and fail the base rule. A null or unknown language is compared by characters
with the sum over all such documents, or not at all where there are none. Very long texts are handled whole. Rows are
judged one by one, so ties and repeated rows don't matter; an empty table gives an empty result. Other columns pass
through; columns named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common words of the languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on are this from or an at not which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más es o".split(),
}
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"#*$%&|<>"
#: Classes of characters; what is neither white space nor in a class is a bin of its own.
CLASSES = ("A-Z", "0-9", r".,;:!?", SYMBOLS, r"\"'()\[\]{}=_+/\\@^~`-", r"\x{80}-\x{10FFFF}")
MIN_WORDS = 50
MIN_CHARS = 100
MAX_CHAR_DISTANCE = 0.33
#: Short texts stray further from their language: the limit is the first number and the second over the root of their words.
MAX_WORD_DISTANCE = (0.26, 0.7)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _of_class(text: Column, chars: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    df = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    # Small letters and white space are most of a text; classes of characters are counted in what is left.
    return df.withColumn("_q_words", F.regexp_extract_all("_q_text", F.lit(WORD), 0)).withColumn(
        "_q_residue", F.regexp_replace("_q_text", r"[a-z\x20\x09-\x0D]+", "")
    )


def _let(value: Column, body) -> Column:
    """body of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Hashes of the windows are sorted together with their places, which makes repeats neighbours. A repeated window
    covers three words, less those that the next one covers as well.
    """

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def same(keys: Column, i: Column, k: Column) -> Column:
        return F.coalesce(F.get(keys, i) == k, F.lit(False))

    def repeated(sorted_: Column) -> Column:
        return _let(
            sorted_["h"],
            lambda keys: F.sort_array(F.filter(sorted_, lambda x, i: same(keys, i - 1, x["h"]) | same(keys, i + 1, x["h"]))["p"]),
        )

    def windows(h: Column) -> Column:
        return F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))
        )

    def placed(w: Column) -> Column:
        return F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    # Only texts with a repeat are sorted.
    return _let(
        _let(F.transform(words, lambda x: F.xxhash64(x)), windows),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            _let(placed(w), lambda s: _let(repeated(s), covered))
        ),
    )


def _with_base(df: DataFrame) -> DataFrame:
    lines = F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(WORD))
    return (
        df.withColumn("n_words", F.size("_q_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_q_words", "")).cast("long"))
        .withColumn("n_symbols", _of_class(F.col("_q_residue"), SYMBOLS))
        .withColumn("n_dup_lines", _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", _let(F.col("_q_words"), _repeat_words).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of BASE and base_failed.

    Repeated windows are found by a 64-bit hash of their three words.
    """
    return _with_base(_with_words(docs, text)).drop("_q_text", "_q_words", "_q_residue")


def _common(all_words: Column, words: list[str]) -> Column:
    """Counts of the words, small or not, alone or with a mark behind."""
    forms = [f + mark for w in words for f in dict.fromkeys((w, w.capitalize(), w.upper())) for mark in ("", ",", ".")]
    found = F.lower(F.array_join(F.filter(all_words, lambda x: x.isin(forms)), "  "))
    # Found words stand between two spaces each, so that counting one never takes its neighbour's.
    return _let(
        F.concat(F.lit(" "), F.regexp_replace(found, "[.,]", ""), F.lit(" ")),
        lambda s: F.array(*((F.length(s) - F.length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / F.lit(float(len(w) + 2)) for w in words)),
    )


def _with_histograms(df: DataFrame, lang: str) -> DataFrame:
    """df with _q_lang, _q_chars and _q_common (null where the language has no list)."""
    n_chars = F.char_length(F.array_join("_q_words", "")).cast("long")
    chars = F.array(*(_of_class(F.col("_q_residue"), c) for c in CLASSES))
    df = df.withColumn("_q_lang", F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise(""))
    df = df.withColumn("_q_chars", _let(chars, lambda c: F.concat(c, F.array(n_chars - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)))))
    common = F.lit(None).cast("array<double>")
    for k, words in COMMON_WORDS.items():
        common = F.when(F.col("_q_lang") == k, _common(F.col("_q_words"), words)).otherwise(common)
    n_words = F.size("_q_words")
    return df.withColumn("_q_common", _let(common, lambda f: F.concat(f, F.array(n_words - F.aggregate(f, F.lit(0.0), lambda a, x: a + x)))))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, dict[str, list[float]]]:
    """Language -> its histograms, over all documents that are long enough. As many as COMMON_WORDS and one more."""
    df = _with_histograms(_with_words(docs, text).where(F.size("_q_words") >= MIN_WORDS), lang)
    n = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("_q_chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum(F.get("_q_common", F.lit(i))).alias(f"w{i}") for i in range(n)]
    out = {}
    for r in df.groupBy("_q_lang").agg(*sums).collect():
        chars = [float(r[f"c{i}"] or 0) for i in range(len(CLASSES) + 1)]
        words = [float(r[f"w{i}"] or 0) for i in range(len(COMMON_WORDS.get(r["_q_lang"], [])) + 1)]
        out[r["_q_lang"]] = {"chars": chars, "words": words if r["_q_lang"] else []}
    return out


def _distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of counts to a reference that isn't empty; null without counts."""
    total = sum(reference)
    q = [x / total for x in reference]

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log(x / m)).otherwise(0.0)

    def of(p: Column) -> Column:
        parts = F.zip_with(p, F.array(*map(F.lit, q)), lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
        divergence = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / (2 * math.log(2))
        return F.sqrt(F.greatest(divergence, F.lit(0.0)))

    def shares(c: Column, n: Column) -> Column:
        return F.when(n > 0, _let(F.transform(c, lambda x: x / n), of))

    return _let(counts, lambda c: _let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda n: shares(c, n)))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    references: dict[str, dict[str, list[float]]] | None = None,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: tuple[float, float] = MAX_WORD_DISTANCE,
) -> DataFrame:
    """docs with base counts, base_failed, char_distance, word_distance (null: not compared) and kept.

    references: those of another corpus; else they are summed over docs.
    """
    references = language_references(docs, text, lang) if references is None else references
    df = _with_histograms(_with_base(_with_words(docs, text)), lang)
    chars = words = F.lit(None).cast("double")
    doubles = F.col("_q_chars").cast("array<double>")
    for k, r in references.items():
        if sum(r["chars"]) > 0:
            chars = F.when(F.col("_q_lang") == k, _distance(doubles, r["chars"])).otherwise(chars)
        if sum(r["words"]) > 0:
            words = F.when(F.col("_q_lang") == k, _distance(F.col("_q_common"), r["words"])).otherwise(words)
    df = df.withColumn("char_distance", F.when(F.col("word_chars") >= MIN_CHARS, chars))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, words))
    most = max_word_distance[0] + max_word_distance[1] / F.sqrt("n_words")
    odd = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > most, F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~odd).drop("_q_text", "_q_words", "_q_residue", "_q_lang", "_q_chars", "_q_common")
