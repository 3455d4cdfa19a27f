"""Text expressions: tokens, term counts, query cleaning, labels. All JVM-side but for the stemmer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}_]+"
#: Function words that count as stop words. A parameter: pass another list where one is at hand.
STOP_WORDS = ("a an the and or but if of at by for with about to from in on off over under is am are was were be been being have has had do does did i you he she it we they me him her us them my your his its our their this that these those who whom which what when where why how all any both each few more most other some such no nor not only own same so than too very can will just should now then there here as into through before after between out up down again once because until while during above below against further").split()


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores in any script; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def with_terms(rows: DataFrame, stemmed: bool = False) -> DataFrame:
    """rows with words (sorted tokens of text), n (how many), terms (distinct, sorted) and tfs, all made inside the row: nothing is shuffled.

    stemmed: tokens are replaced by their stems.
    """
    made = tokens(F.col("text"))
    return run_lengths(rows, stems(made) if stemmed else made)


def run_lengths(rows: DataFrame, made: Column) -> DataFrame:
    """rows with words (the strings of an array, sorted), n, terms and tfs, as with_terms has them of tokens."""
    out = rows.withColumn("words", F.sort_array(made)).withColumn("n", F.size("words"))
    first = lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))
    out = out.withColumn("_at", F.when(F.col("n") > 0, F.filter(F.sequence(F.lit(0), F.col("n") - 1), first)).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), F.array("n"))
    tfs = F.when(F.col("n") > 0, F.zip_with("_at", ends, lambda a, b: b - a)).otherwise(F.array().cast("array<int>"))
    return out.withColumns({"terms": F.transform("_at", lambda i: F.get("words", i)), "tfs": tfs}).drop("_at")


#: Tokens that are counted at once, and stems that a task remembers.
AT_ONCE, KNOWN = 1_000_000, 500_000


def _counts(words: pa.ListArray, stem: Callable[[str], str] | None) -> list[pa.Array]:
    """n, terms (distinct, sorted) and tfs of each array of words."""
    lengths, coded = pc.list_value_length(words), words.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy()
    if stem:
        coded = pa.array(list(map(stem, names.to_pylist())), pa.string()).dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy()[codes]
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows = np.repeat(np.arange(len(words)), lengths.to_numpy())
    key, tf = np.unique(rows * max(1, len(names)) + place[codes], return_counts=True)
    row, term = np.divmod(key, max(1, len(names)))
    offsets = pa.array(np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32))
    return [lengths.cast(pa.int32()), pa.ListArray.from_arrays(offsets, names.take(pa.array(order[term]))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))]


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch with a column words in parts of that many words, or of one row."""
    upto = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def counted_terms(rows: DataFrame, keep: list[str], stemmed: bool = False, also: tuple[str, str, Callable[[pa.ListArray], pa.Array]] | None = None) -> DataFrame:
    """keep's columns of rows, n, terms and tfs as with_terms() has them of the column text, counted for many rows at once. Each distinct word is stemmed once for AT_ONCE tokens or more.

    also: one more column, with its type and what makes it from arrays of tokens in their order.
    """
    made = rows.select(*keep, tokens(F.col("text")).alias("words"))
    more = [also[0]] if also else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}

        def stem(w: str) -> str:
            out = known.get(w)
            if out is None:
                if len(known) >= KNOWN:
                    known.clear()
                out = known[w] = porter_stem(w)
            return out

        for batch in batches:
            for some in slices(batch, AT_ONCE):
                words = some.column("words")
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), *_counts(words, stem if stemmed else None), *([also[2](words)] if also else [])], [*keep, "n", "terms", "tfs", *more])

    return made.mapInArrow(run, T.StructType([*(made.schema[c] for c in keep), *T.StructType.fromDDL("n int, terms array<string>, tfs array<int>" + (f", {also[0]} {also[1]}" if also else ""))]))


def term_counts(corpus: DataFrame, stemmed: bool = False) -> DataFrame:
    """docno, term, tf, len of each row of corpus."""
    rows = with_terms(corpus.select("docno", "text"), stemmed)
    return exploded_terms(rows, ["docno", F.col("n").cast("long").alias("len")]).select("docno", "term", F.col("tf").cast("long").alias("tf"), "len")


def exploded_terms(rows: DataFrame, keep: list) -> DataFrame:
    """keep's columns, term and tf of with_terms' rows.

    The outer form keeps Spark from testing the arrays' size before it made their parts: the test would
    go below the projections and tokenize a text anew for each of its elements.
    """
    made = rows.select(*keep, F.explode_outer(F.arrays_zip("terms", "tfs")).alias("x"))
    return made.select("*", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf")).drop("x").where(F.col("term").isNotNull())


#: What goes out of a query.
OPERATORS, MARKS = r"[:(){}\[\]^\"~*?\\/+!\-]", r"[^\p{L}\p{N}_\s]"


def clean_query(query: Column) -> Column:
    """A query without operators and marks; runs of white space become one space."""
    out = F.regexp_replace(F.regexp_replace(query, OPERATORS, " "), MARKS, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def text_id(text: Column) -> Column:
    """The id of a passage that comes without one."""
    return F.concat(F.lit("txt_"), F.md5(F.encode(text, "UTF-8")))


#: Words that are read as true and as false.
TRUE_WORDS = ("true", "1", "1.0", "yes", "y", "si", "sì", "t")
FALSE_WORDS = ("false", "0", "0.0", "no", "n", "f", "", "nan", "none")


def parse_boolean(text: Column) -> Column:
    """TRUE_WORDS and FALSE_WORDS, whatever the case, and null is false; null for anything else, so that a caller can reject it."""
    low = F.lower(F.trim(text))
    return F.when(text.isNull(), F.lit(False)).when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))


def safe_file_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def system_family(name: Column) -> Column:
    """'BM25 Full' to (family, kind)."""
    pattern = r"^(.*) (Full|Pruned)$"
    return F.struct(F.regexp_extract(name, pattern, 1).alias("family"), F.regexp_extract(name, pattern, 2).alias("kind"))


def prompt(text: Column) -> Column:
    return F.concat(F.lit("Document: "), text, F.lit(" Relevant:"))


def config_id(*parts: Column, threshold: Column) -> Column:
    return F.concat_ws(" | ", *parts, F.concat(F.lit("thr="), threshold.cast("string")))


_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return False if c in _VOWELS else (i == 0 or not _consonant(w, i - 1)) if c == "y" else True


#: Without a y, which is either, letters say it themselves.
_PAIR, _VOWEL = re.compile(f"[{_VOWELS}][^{_VOWELS}]", re.DOTALL), re.compile(f"[{_VOWELS}]")


def _measure(w: str) -> int:
    if "y" not in w:
        return len(_PAIR.findall(w))
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return sum(shape[i : i + 2] == "vc" for i in range(len(shape) - 1))


def _has_vowel(w: str) -> bool:
    if "y" not in w:
        return _VOWEL.search(w) is not None
    return any(not _consonant(w, i) for i in range(len(w)))


def _short(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


#: The suffix rules of the published stemming algorithm (M. F. Porter, 1980), steps 2 to 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_RULES2, _RULES3 = (sorted((r.split(":") for r in s.split()), key=lambda r: -len(r[0])) for s in (_STEP2, _STEP3))
_RULES4 = sorted(_STEP4.split(), key=len, reverse=True)
_ENDS2, _ENDS3, _ENDS4 = tuple(r[0] for r in _RULES2), tuple(r[0] for r in _RULES3), tuple(_RULES4)


def porter_stem(w: str) -> str:
    """The stem of a lower-case word."""
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules, ends in ((_RULES2, _ENDS2), (_RULES3, _ENDS3)):
        for suffix, put in rules if w.endswith(ends) else ():
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                w = stem + put if _measure(stem) > 0 else w
                break
    for suffix in _RULES4 if w.endswith(_ENDS4) else ():
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(words: pa.Array) -> pa.Array:
    """The stems of arrays of words; each distinct word of a batch is stemmed once, and no row is taken apart."""
    coded = words.flatten().dictionary_encode()
    stem = pa.array([None if w is None else porter_stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    offsets = pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), offsets.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, stem.take(coded.indices), mask=words.is_null())
