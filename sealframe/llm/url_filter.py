"""URL filters: fixed rules by host suffix and path prefix, then a tree of path templates with labelled purity.

For each host a tree of path segments is built level by level, as deep as paths go. Segments are first written by class
(digits, digits among letters). At each node the branches' own labels are looked at first: of the small branches of a node
that has many of them, those whose labels differ from the others' stay, and the rest become a wildcard. Branches that stay
and have labels are merged with those whose share of bad labels is statistically the same, the most similar first. A
template is rejected if its share of bad labels, smoothed towards the whole table's, is high.

All steps are joins, windows and aggregations of counts: pages themselves are only counted and marked, and windows are over
the distinct shares of a node's branches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealframe.llm.shared import cut, small

#: A branch is small with fewer pages than this, or a smaller share of its level's pages; a node with at least so many
#: small branches has a variable segment.
PAGES, SHARE, BRANCHES = 25, 0.01, 12
#: Shares of bad labels are the same if they differ by less than so many standard errors.
STANDARD_ERRORS = 3.0
#: Pseudo-labels at the table's rate that smooth a template's; share of bad labels from which it is rejected.
WEIGHT, LIMIT = 10.0, 0.5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both are empty for a null url or one without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. rules: (verdict, "host/path") from the configuration."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones are longer and win
        of, slash, start = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def segment_class(segment: Column) -> Column:
    """{n} for digits, {id} for letters with digits, else the segment; the sign of the wildcard is written otherwise."""
    digits = F.translate(segment, "0123456789", "")
    return F.when((digits == "") & (segment != ""), "{n}").when(F.length(digits) < F.length(segment), "{id}").when(segment == "*", "%2A").otherwise(segment)


def shape_of(path: Column) -> Column:
    """The classes of a path's segments, joined by slashes; empty segments don't count."""
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), segment_class), "/")


def errors_apart(bad: Column, labelled: Column, bad2: Column, labelled2: Column) -> Column:
    """By how many standard errors two shares of bad labels differ; each has one more label of either kind."""
    share = lambda b, n: (b + 1) / (n + 2)
    spread = lambda b, n: share(b, n) * (1 - share(b, n)) / (n + 2)
    return F.abs(share(bad, labelled) - share(bad2, labelled2)) / F.sqrt(spread(bad, labelled) + spread(bad2, labelled2))


def merged(branches: DataFrame) -> DataFrame:
    """host, template, rate, least: by rate of a node's labelled branches, the lowest rate of those that it is merged with.

    branches: host, template, labelled, bad. Branches of one rate are one group from the start. Then groups are put in
    order of their smoothed shares, and each two neighbours that are more like each other than like their other
    neighbours merge, if they are no STANDARD_ERRORS apart, until no two are.
    """
    groups = branches.groupBy("host", "template", (F.col("bad") / F.col("labelled")).alias("least")).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    groups = groups.withColumn("rates", F.array("least"))
    at = Window.partitionBy("host", "template").orderBy((F.col("bad") + 1) / (F.col("labelled") + 2), "least")
    while True:
        apart = errors_apart(F.col("bad"), F.col("labelled"), F.lead("bad").over(at), F.lead("labelled").over(at))
        near = groups.withColumn("z", apart)
        nearest = (F.col("z") < STANDARD_ERRORS) & (F.col("z") < F.coalesce(F.lag("z").over(at), F.lit(float("inf")))) & (F.col("z") <= F.coalesce(F.lead("z").over(at), F.lit(float("inf"))))
        near = near.withColumn("joins", F.coalesce(nearest, F.lit(False)))
        near = cut(near.withColumn("least", F.when(F.coalesce(F.lag("joins").over(at), F.lit(False)), F.lag("least").over(at)).otherwise(F.col("least"))))
        if near.where("joins").isEmpty():
            return near.select("host", "template", F.explode("rates").alias("rate"), "least")
        groups = near.groupBy("host", "template", "least").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.flatten(F.collect_list("rates")).alias("rates"))


def tree(counted: DataFrame) -> DataFrame:
    """host, shape, template, share: the smoothed share of bad labels of each shape's template; null without labels.

    counted: host, shape, n, labelled, bad (a checkpoint). A level joins shapes to counts of their nodes, which are
    aggregated first; these joins are left to adaptive execution, which broadcasts small sides by their measured size and
    splits skewed ones. A shape that is alone in its node needs no further levels.
    """
    node, sums = ["host", "template"], [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    todo = counted.withColumn("template", F.lit("")).withColumn("segments", F.filter(F.split("shape", "/"), lambda x: x != ""))
    done = [todo.where("size(segments) = 0").drop("segments")]
    level, todo = 0, todo.where("size(segments) > 0")
    while not todo.isEmpty():
        at = F.get("segments", level)
        nodes = cut(todo.groupBy(*node, at.alias("s")).agg(*sums, F.count("*").alias("shapes")))
        of = nodes.groupBy(*node).agg(F.sum("n").alias("level_n"), F.sum("shapes").alias("level_shapes"), F.count("*").alias("level_branches"))
        nodes = nodes.join(of, node).withColumn("few", (F.col("n") < PAGES) | (F.col("n") < SHARE * F.col("level_n")))
        pool = nodes.where("few").groupBy(*node).agg(F.count("*").alias("branches"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")).where(F.col("branches") >= BRANCHES)
        apart = errors_apart(F.col("bad"), F.col("labelled"), F.col("all_bad") - F.col("bad"), F.col("all_labelled") - F.col("labelled"))
        wild = F.col("few") & F.col("branches").isNotNull() & ~((F.col("labelled") > 0) & (F.col("all_labelled") > F.col("labelled")) & (apart >= STANDARD_ERRORS))
        # a class of segments that has no other branch beside it is a wildcard as well
        label = F.when((F.col("level_branches") == 1) & F.col("s").isin("{n}", "{id}"), "*").otherwise(F.col("s"))
        nodes = cut(nodes.join(pool, node, "left").withColumn("wild", wild).select(*node, "s", label.alias("label"), "labelled", "bad", "wild", "level_shapes"))
        own = nodes.where("not wild and labelled > 0")
        own = own.withColumn("rate", F.col("bad") / F.col("labelled")).join(merged(own), [*node, "rate"])
        names = own.groupBy(*node, "least").agg(F.min("label").alias("name"), F.count("*").alias("k"))
        own = own.join(names, [*node, "least"]).select(*node, "s", F.when(F.col("k") > 1, F.concat("name", F.lit(" +"), (F.col("k") - 1).cast("string"))).otherwise(F.col("name")).alias("step"), "level_shapes")
        rest = nodes.where("wild or labelled = 0").select(*node, "s", F.when(F.col("wild"), "*").otherwise(F.col("label")).alias("step"), "level_shapes")
        named = own.unionAll(rest).select(F.col("host").alias("__host"), F.col("template").alias("__template"), F.col("s").alias("__s"), "step", "level_shapes")
        todo = todo.join(named, (todo["host"] == F.col("__host")) & (todo["template"] == F.col("__template")) & (at == F.col("__s")))
        alone, level = F.col("level_shapes") == 1, level + 1
        ended = alone | (F.size("segments") == level)
        template = F.when(alone, F.concat("template", F.lit("/"), F.array_join(F.slice("segments", F.lit(level), F.size("segments") - level + 1), "/"))).otherwise(F.concat("template", F.lit("/"), "step"))
        todo = cut(todo.select("host", "shape", "n", "labelled", "bad", template.alias("template"), "segments", ended.alias("ended")))
        done.append(todo.where("ended").drop("segments", "ended"))
        todo = todo.where("not ended").drop("ended")
    leaves = done[0]
    for part in done[1:]:
        leaves = leaves.unionByName(part)
    total = leaves.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = total[0] / total[1] if total[1] else 0.0
    shares = leaves.groupBy(*node).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    # a template without labels has no share: nothing speaks against it
    shares = shares.where("labelled > 0").select(*node, ((F.col("bad") + WEIGHT * prior) / (F.col("labelled") + WEIGHT)).alias("share"))
    return leaves.select("host", "shape", "template").join(shares, node, "left")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """pages with host, path, rule, template, share and verdict; their own columns of these names are replaced.

    labels: url, bad (boolean); several labels of a url all count, null ones don't; its other columns are ignored. A
    rule's verdict goes before the tree's. Null and odd urls have an empty host and path and are judged as such. Repeated
    rows are judged alike; an empty table gives an empty one, and without labels all is allowed. Branches that are equally
    like their neighbours merge with the one of the lower share. Paths of any length and depth are read whole.
    """
    made = ["host", "path", "rule", "template", "share", "verdict"]
    host, path = split_url(F.col(url))
    pages = pages.drop(*[c for c in made if c != url]).withColumns({"host": host, "path": path}).withColumn("__shape", shape_of(F.col("path")))
    host, path = split_url(F.col("url"))
    named = labels.select("url", "bad").where("bad is not null").withColumns({"host": host, "path": path}).withColumn("__shape", shape_of(F.col("path")))
    counts = pages.groupBy("host", "__shape").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("bad"))
    counts = counts.unionAll(named.groupBy("host", "__shape").agg(F.lit(0).cast("long"), F.count("*"), F.count_if("bad")))
    counts = cut(counts.groupBy("host", F.col("__shape").alias("shape")).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    leaves = cut(tree(counts).select(F.col("host").alias("__host"), F.col("shape").alias("__of"), "template", "share"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = pages.join(small(leaves), (pages["host"] == F.col("__host")) & (pages["__shape"] == F.col("__of")), "left").withColumns({"rule": rule, "verdict": verdict})
    learned = F.when(F.col("share") >= LIMIT, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("verdict", learned)).drop("__host", "__of", "__shape")


#: The query's rules.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def digests(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts of all pages. A page's label is that of the document whose number its path ends with; toxic ones are bad.

    template and share tell where the tree's verdict comes from, for all pages.
    """
    number = F.regexp_extract(split_url(F.col("url"))[1], r"([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    urls = pages.select("url", number.alias("number")).where("number <> ''").select("url", F.col("number").cast("long").alias("id"))
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("bad"))
    return judge_urls(pages.select("page_id", "url"), urls.join(known, "id").select("url", "bad"), RULES).select("page_id", "host", "path", "rule", "verdict", "template", "share")
