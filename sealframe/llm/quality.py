"""Quality rules for documents, with a verdict on their hosts.

Every document is measured by built-in functions on its row alone. Failures of each rule are counted by host, and a
host's failure rate is shrunk towards the rule's mean over hosts by a beta prior whose two parameters come from the hosts'
own rates (method of moments): a host of few documents keeps close to the mean, one of many keeps its own rate. A host
whose shrunk rate of any rule reaches the limit is rejected, and the verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealframe.llm.shared import SPACE, as_table, cut, opaque, small

#: Characters that separate words, and those that count as symbols.
SEPARATORS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"

#: A host is rejected at this shrunk failure rate: at least this share of its documents is expected to fail one rule.
LIMIT = 0.6
#: Bounds of the prior's weight in documents: a host of few documents is never judged by these alone, and hosts that hardly
#: differ are still judged by their own rates in the end.
LEAST_WEIGHT, MOST_WEIGHT = 10.0, 1000.0

#: Words in a window of n_repeat_words.
WINDOW = 3

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: By rule: what fails it. The first two are the base: they reject a document by themselves.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
BASE = ("short", "repeats")


def window_hashes(words: Column, n: int = WINDOW) -> Column:
    """A hash of each window of n words; null for fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n)))))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long; a null text has no words).

    Columns of these names in docs are replaced.
    """
    has_word = lambda x: F.length(F.translate(x, SEPARATORS, "")) > 0
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), has_word)
    out = docs.drop(*MEASURES, "n_lines").withColumn("__words", F.filter(F.split(t, SPACE), lambda x: x != "")).withColumn("__lines", lines)
    out = out.withColumn("__windows", window_hashes(F.col("__words")))
    out = out.select(
        *[c for c in docs.columns if c not in (*MEASURES, "n_lines")],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate(t, SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "__words",
        # only texts in which a window occurs twice are sorted
        F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__sorted"),
    )
    # neighbours of one hash and the same words are repeats
    at = lambda i: F.get("__sorted", i)
    same = lambda i, j: (at(i)["h"] == at(j)["h"]) & F.forall(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.get("__words", at(i)["i"] + k) == F.get("__words", at(j)["i"] + k))
    found = F.transform("__sorted", lambda x, i: F.when((i > 0) & same(i, i - 1) | (i < F.size("__sorted") - 1) & same(i, i + 1), x["i"]))
    out = out.withColumn("__places", F.sort_array(F.filter(found, lambda x: x.isNotNull())))
    # each place covers the words up to the next one, WINDOW at most
    repeated = F.aggregate("__places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return out.withColumn("n_repeat_words", opaque(F.coalesce(repeated, F.lit(0).cast("long")))).drop("__words", "__sorted", "__places")


def with_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """with_measures plus failed (a struct of a boolean for each rule) and base_failed."""
    out = with_measures(docs.drop("failed", "base_failed"), text)
    return out.withColumn("failed", F.struct(*(F.expr(x).alias(k) for k, x in RULES.items()))).withColumn("base_failed", F.expr(" or ".join(f"failed.{k}" for k in BASE)))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """host, rule, n, n_failed, rate: failure rates by host and rule, shrunk by the rule's beta prior.

    The prior's mean is the rule's failures over all documents; its weight a + b = m (1 - m) / v - 1, with v the
    variance of rates between hosts (weighted by documents) less what sampling alone explains, within LEAST_WEIGHT and
    MOST_WEIGHT. Documents without a host are one host, null.
    """
    by_host = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *(F.count_if(F.col(f"failed.{k}")).alias(k) for k in RULES))
    by_host = cut(by_host.select("host", "n", F.explode(F.create_map(*(x for k in RULES for x in (F.lit(k), F.col(k))))).alias("rule", "n_failed")))
    share = F.col("n_failed") / F.col("n")
    prior = by_host.groupBy("rule").agg((F.sum("n_failed") / F.sum("n")).alias("m"), (F.sum(F.col("n") * share * share) / F.sum("n")).alias("square"), (F.count("*") / F.sum("n")).alias("sampling"))
    between = F.greatest(F.col("square") - F.col("m") * F.col("m") - F.col("m") * (1 - F.col("m")) * F.col("sampling"), F.lit(1e-12))
    prior = prior.select("rule", "m", F.least(F.greatest(F.col("m") * (1 - F.col("m")) / between - 1, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)).alias("weight"))
    # a row for each rule
    joined = by_host.join(F.broadcast(prior), "rule")
    return joined.select("host", "rule", "n", "n_failed", ((F.col("n_failed") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("rate"))


def rejected_hosts(measured: DataFrame, host: str, limit: float = LIMIT) -> DataFrame:
    """host of the rejected hosts, each once (checkpointed): those with a shrunk rate of some rule at or over the limit."""
    return cut(host_rates(measured, host).where(F.col("rate") >= limit).select("host").distinct())


def judge(measured: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    """measured (with base_failed) plus host_rejected and kept; hosts are joined by a size-checked broadcast.

    Beyond that size the hosts are joined by a shuffle that Spark splits where one host has many rows.
    """
    marked = hosts.select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
    out = measured.join(small(marked), measured[host].eqNullSafe(F.col("__host")), "left")
    out = out.withColumn("host_rejected", F.coalesce("__bad", F.lit(False))).drop("__host", "__bad")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", limit: float = LIMIT) -> DataFrame:
    """Measures, rules and verdicts of every row of docs, without its text; other columns stay.

    Null texts count as empty and fail; texts of any length are read whole; null hosts are one host; repeated rows are
    judged alike; an empty table gives an empty one. Hosts whose rate is the limit itself are rejected. Columns of the names
    that this adds are replaced.
    """
    measured = cut(with_rules(docs.drop("host_rejected", "kept"), text).drop(text))
    return judge(measured, rejected_hosts(measured, host, limit), host)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", limit: float = LIMIT) -> DataFrame:
    """docs without the rows that the rules or their host's verdict reject.

    Texts are measured once: a table in the shared folder holds all rows' hosts and rules, and of the rows that pass the
    base rules the whole row. Hosts are judged from its narrow columns, and the rows are read back from it.
    """
    own = F.struct(*(F.col(c) for c in docs.columns))
    measured = with_rules(docs.select(own.alias("__own"), F.col(text).alias("__text"), F.col(host).alias("__host")), "__text")
    stored = as_table(measured.select("__host", "base_failed", "failed", F.when(~F.col("base_failed"), F.col("__own")).alias("__own")), "measured")
    kept = judge(stored.select("__host", "base_failed", "__own").withColumnRenamed("__host", "__of"), rejected_hosts(stored, "__host", limit), "__of").where("kept")
    return kept.select(*(F.col("__own").getField(c).alias(c) for c in docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept of every row."""
    return quality_rules(docs.select("doc_id", "source", "text")).select("doc_id", *MEASURES, "base_failed", "kept")


def _sql() -> str:
    """digests() in DuckDB's SQL."""
    white, failed = "[ \\t\\n\\x0b\\f\\r]", ", ".join(f"({x}) as {k}" for k, x in RULES.items())
    rates = " union all ".join(f"select host, n, {k} as n_failed, '{k}' as rule from by_host" for k in RULES)
    counts = ", ".join(f"count(*) filter ({k}) as {k}" for k in RULES)
    return f"""
with d as (select row_number() over () as rn, doc_id, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '{white}+'), lambda x: x <> '') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) as lines from d),
spots as (select rn, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from w),
windows as (select rn, i, words[i:i + {WINDOW - 1}] as k from spots),
again as (select rn, i from (select rn, i, count(*) over (partition by rn, k) as n from windows) where n > 1),
covered as (select rn, count(distinct j) as n from (select rn, unnest(range(i, i + {WINDOW})) as j from again) group by rn),
measured as (
  select rn, doc_id, source as host, len(words) as n_words, length(regexp_replace(t, '{white}', '', 'g')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
  from w left join covered c using (rn)),
failed as (select *, {failed} from measured),
by_host as (select host, count(*) as n, {counts} from failed group by host),
shares as ({rates}),
prior as (select rule, sum(n_failed) / sum(n) as m, sum(n * (n_failed / n) * (n_failed / n)) / sum(n) as square, count(*) / sum(n) as sampling from shares group by rule),
weights as (select rule, m, least(greatest(m * (1 - m) / greatest(square - m * m - m * (1 - m) * sampling, 1e-12) - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) as weight from prior),
rejected as (select distinct host, true as bad from shares join weights using (rule) where (n_failed + m * weight) / (n + weight) >= {LIMIT})
select doc_id, {", ".join(f"{c}::bigint as {c}" for c in MEASURES)}, ({" or ".join(BASE)}) as base_failed, not ({" or ".join(BASE)}) and r.bad is null as kept
from failed f left join rejected r on f.host is not distinct from r.host
"""


SQL = _sql()
