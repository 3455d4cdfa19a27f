"""Operator 11, quality rules: weak supervision instead of an all-must-pass filter.

Each rule votes good (1) or bad (0) on a document, or abstains (null). Its accuracy, the share of its
votes that are right, is estimated from all documents' votes by expectation-maximisation. Good and bad
are as likely before any vote, as the accuracies hold the shares of the classes. A document's quality is
the posterior probability that it is good; it is kept from KEEP on.

Every rule starts with the accuracy that its author trusts it with, and that trust counts as TRUST
times its votes in every round: a maximum a posteriori estimate, alike at every size. Without it the
estimates run into a corner where one kind of junk teaches that the rules against another kind err.

All work on documents is made inside the row by DataFrame functions, read once and without a shuffle
of texts. The estimation runs over the votes' patterns, a few hundred rows at most whatever the corpus (the product of each rule's possible votes): each
of ROUNDS rounds is an expression over the row that holds them, and its result a single row.

Equal windows of words are found by sorting 64-bit hashes of the windows; where hashes meet, the words
themselves decide.

Defined cases: a null or empty text has no words; every rule abstains and the document fails the base
rule. Ties of the posterior (exactly KEEP) are kept. Repeated rows are rows of their own and count each
time. An empty table gives an empty result. Very long texts are taken whole; a text's words, windows'
hashes and (of a text that repeats itself) windows are in memory together. Extra columns, whatever
their names, are not looked at; no column but doc_id and text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_documents, text_of

SPACE, SPACES = "\t\n\x0b\f\r ", r"[\x20\x09-\x0D]+"
WORD, LETTER = r"[^\x20\x09-\x0D]+", r"\p{L}"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8  #: words of a window that may repeat, a power of two
ROUNDS, KEEP = 20, 0.5
TRUST = 0.5  #: votes that the start counts as, for each vote of a rule

#: name: (accuracy at the start, good if, bad if). The conditions are SQL that Spark and other engines read alike; a rule that says neither abstains.
RULES = {
    "prose": (0.9, "word_chars BETWEEN 4 * n_words AND 7 * n_words AND 50 * n_ends >= n_words AND 3 * n_ends <= n_words AND 50 * n_symbols <= n_words AND 10 * n_lettered >= 9 * n_words AND n_capitals <= n_words", "FALSE"),
    "fresh": (0.7, "n_words >= 20 AND n_dup_lines = 0 AND n_repeat_words = 0 AND 50 * n_symbols <= n_words", "FALSE"),
    "word_length": (0.9, "FALSE", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    "symbols": (0.9, "FALSE", "10 * n_symbols > n_words"),
    "lines": (0.8, "FALSE", "2 * n_dup_lines > n_lines"),
    "repeats": (0.8, "FALSE", "4 * n_repeat_words > n_words"),
    "letters": (0.9, "FALSE", "5 * n_lettered < 4 * n_words"),
    "capitals": (0.9, "FALSE", "n_capitals > 2 * n_words"),
    "sentences": (0.9, "FALSE", "2 * n_ends > n_words"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lettered", "n_capitals", "n_ends")
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def vote(rule: str) -> str:
    _, good, bad = RULES[rule]
    return f"CASE WHEN n_words = 0 THEN NULL WHEN {good} THEN 1 WHEN {bad} THEN 0 END"


def _neighbour_equal(of: str, i: Column, field: str) -> Column:
    """Element i of a sorted array has a neighbour with the same field."""
    at = lambda j: F.get(F.col(of), j)[field]
    same = lambda j: F.coalesce(at(i) == at(j), F.lit(False))
    return same(i - 1) | same(i + 1)


def _sorted_repeats(df: DataFrame, pairs: Column, field: str, name: str) -> DataFrame:
    """Column name: ascending positions of pairs (field, at) whose field is there twice or more."""
    df = df.withColumn("_pairs", F.sort_array(pairs)).withColumn("_size", F.size("_pairs"))
    twice = F.filter(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: _neighbour_equal("_pairs", i, field))
    df = df.withColumn(name, F.when(F.col("_size") > 1, F.transform(twice, lambda i: F.get(F.col("_pairs"), i)["at"])))
    return df.drop("_pairs", "_size")


def counts(docs: DataFrame, keep: list) -> DataFrame:
    """keep's columns, then COUNTS as long, of the column text. Made inside the row."""
    n = F.col("n_words")
    rows = docs.select(*keep, text_of().alias("_t"))
    # split is faster than extracting words; an end that is no word goes
    parts = F.split(F.trim("_t", F.lit(SPACE)), SPACES)
    rows = rows.withColumn("_w", F.when(F.rlike("_t", F.lit(WORD)), parts).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    rows = rows.withColumns({"n_words": F.size("_w"), "_l": lines})
    # a window's hash is made of its halves' hashes, theirs of their halves': four passes whatever the window's width
    rows = rows.withColumn("_h", F.when(n >= WINDOW, F.transform("_w", lambda x: F.xxhash64(x))))
    width = 1
    while width < WINDOW:
        rows = rows.withColumn("_h", F.zip_with("_h", F.slice("_h", width + 1, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    rows = rows.withColumn("_h", F.slice("_h", 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
    # most texts repeat no window: only the others are sorted
    again = F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.col("_h"))
    rows = rows.withColumn("_again", again)
    pairs = F.transform("_again", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at")))
    rows = _sorted_repeats(rows, pairs, "h", "_maybe")
    texts = F.transform("_maybe", lambda at: F.struct(F.array_join(F.slice("_w", at, F.lit(WINDOW)), " ").alias("s"), at.alias("at")))
    rows = _sorted_repeats(rows, texts, "s", "_at")
    rows = rows.withColumn("_at", F.sort_array("_at"))
    # a window covers what the next one doesn't, and the last one all its words
    gaps = F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0))
    times = lambda what: F.regexp_count("_t", F.lit(what))
    made = {
        "word_chars": F.char_length(F.array_join("_w", "")),
        "n_symbols": times(SYMBOL),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": repeated,
        "n_lines": F.size("_l"),
        "n_lettered": F.size(F.filter("_w", lambda x: F.rlike(x, F.lit(LETTER)))),
        "n_capitals": times(r"\p{Lu}"),
        "n_ends": times(r"[.!?](?=[\x20\x09-\x0D])"),
    }
    return rows.select(*keep, n.cast("long").alias("n_words"), *(c.cast("long").alias(k) for k, c in made.items()))


def with_votes(counted: DataFrame) -> DataFrame:
    """A column for each rule: 1, 0 or null."""
    return counted.withColumns({r: F.expr(vote(r)) for r in RULES})


def posterior(votes: Column, accuracies: Column) -> Column:
    """Probability that a document is good, from arrays of its votes and of the rules' accuracies."""
    weight = lambda v, a: F.when(v == 1, a / (1 - a)).when(v == 0, (1 - a) / a).otherwise(F.lit(1.0))
    odds = F.aggregate(F.zip_with(votes, accuracies, weight), F.lit(1.0), lambda x, y: x * y)
    return odds / (1 + odds)


def fit(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row, accuracies: an array in the order of RULES, by expectation-maximisation. votes: a column for each rule.

    Only the number of documents of each pattern of votes counts; one row holds all patterns, and the
    rounds are one expression over it.
    """
    every, start = F.array(*RULES), F.array(*(F.lit(x[0]) for x in RULES.values()))
    patterns = votes.groupBy(*RULES).agg(F.count(F.lit(1)).alias("n"))
    one = patterns.agg(F.collect_list(F.struct(every.alias("v"), F.col("n").cast("double").alias("n"))).alias("p"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda x, y: x + y)

    def one_round(accuracies: Column) -> Column:
        def of_rule(qualities: Column, first: Column, j: Column) -> Column:
            vote = lambda p: F.get(p["v"], j)
            right = add(F.zip_with("p", qualities, lambda p, q: F.when(vote(p) == 1, q * p["n"]).when(vote(p) == 0, (1 - q) * p["n"]).otherwise(F.lit(0.0))))
            voted = add(F.transform("p", lambda p: F.when(vote(p).isNotNull(), p["n"]).otherwise(F.lit(0.0))))
            return F.when(voted > 0, (right / voted + TRUST * first) / (1 + TRUST)).otherwise(first)

        qualities = F.array(F.transform("p", lambda p: posterior(p["v"], accuracies)))
        return F.get(F.transform(qualities, lambda qs: F.transform(start, lambda first, j: of_rule(qs, first, j))), F.lit(0))

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda m, _: one_round(m)).alias("accuracies"))


def judge(docs: DataFrame, keep: list, rounds: int = ROUNDS) -> DataFrame:
    """keep's columns, COUNTS, the rules' votes, base_failed, quality (0 to 1) and kept of the column text."""
    voted = materialize(with_votes(counts(docs, keep)), "votes")
    model = materialize(fit(voted, rounds), "accuracies")  # one row
    out = voted.crossJoin(F.broadcast(model))
    out = out.select(*voted.columns, F.expr(BASE_FAILED).alias("base_failed"), F.round(posterior(F.array(*RULES), F.col("accuracies")), 6).alias("quality"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs, ["doc_id"]).select("doc_id", *COUNTS[:5], "base_failed", "kept", "quality")


def _sql() -> str:
    """The same in SQL, its rounds written out."""
    ratio = lambda of, m: " * ".join(f"(CASE {of}.{r} WHEN 1 THEN {m}.{r} / (1 - {m}.{r}) WHEN 0 THEN (1 - {m}.{r}) / {m}.{r} ELSE 1 END)" for r in RULES)
    cell = lambda r, start: f"coalesce((sum(CASE {r} WHEN 1 THEN q * n WHEN 0 THEN (1 - q) * n END) / sum(n) FILTER ({r} IS NOT NULL) + {TRUST * start}) / {1 + TRUST}, {start}) AS {r}"
    cells = ", ".join(cell(r, start) for r, (start, _, _) in RULES.items())
    rounds = ", ".join(f"m{i + 1} AS MATERIALIZED (SELECT {cells} FROM (SELECT *, o / (1 + o) AS q FROM (SELECT pat.*, {ratio('pat', f'm{i}')} AS o FROM pat, m{i})))" for i in range(ROUNDS))
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM t),
win AS (SELECT k, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) AS s FROM w WHERE len(w) >= 8),
tw AS (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM win),
cov AS (SELECT k, count(DISTINCT p) AS c FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM tw WHERE c > 1) GROUP BY k),
c AS (SELECT doc_id, k, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.c, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}')))::BIGINT AS n_lettered,
 length(regexp_replace(t, '\\P{{Lu}}', '', 'g'))::BIGINT AS n_capitals, len(regexp_extract_all(t, '[.!?][\\x20\\x09-\\x0D]'))::BIGINT AS n_ends FROM w LEFT JOIN cov USING (k)),
v AS MATERIALIZED (SELECT *, {", ".join(f"{vote(r)} AS {r}" for r in RULES)} FROM c),
pat AS MATERIALIZED (SELECT {", ".join(RULES)}, count(*) AS n FROM v GROUP BY ALL),
m0 AS MATERIALIZED (SELECT {", ".join(f"{start}::DOUBLE AS {r}" for r, (start, _, _) in RULES.items())}),
{rounds}
SELECT *, NOT base_failed AND quality >= {KEEP} AS kept FROM (SELECT doc_id, {", ".join(COUNTS[:5])}, {BASE_FAILED} AS base_failed, round(o / (1 + o), 6) AS quality FROM (SELECT v.*, {ratio("v", f"m{ROUNDS}")} AS o FROM v, m{ROUNDS}))"""


OP11_SQL = _sql()
