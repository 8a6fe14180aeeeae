"""URL filter as a sort-merge range join, with DataFrame functions only.

A host becomes the array of its labels in reverse, so a rule for a host and all its subdomains is
an interval of sorted keys; within a host, a path prefix is an interval of sorted paths. Interval
ends are events; intervals nest, so each event carries the stack of rules that are open after it.
URLs and events are sorted together and every URL takes the state of the last event before it:
first the stack of open rule hosts, then, per open host, the innermost open path rule.

Sorting happens per shard. A key that holds many URLs is spread over several shards, each with a
copy of that key's events, so no task gets more than a small share of a hot host or domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, hot_keys

#: Largest share of the URLs that one shard of a hot key should hold.
SHARE = 1 / 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0,
                  F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(rest_of(url), r"\A[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(rest_of(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def host_events(rules: DataFrame) -> DataFrame:
    """Events (domain, at, kind, stack) of the rule hosts: kind 0 closes, 1 opens; stack of open hosts.

    The stack of a host is made of those of its label prefixes that are rule hosts too, at most
    127 by the rules of host names.
    """
    hosts = rules.select(labels(F.col("rule_host")).alias("at")).distinct()
    prefixes = hosts.select("at", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("at")), lambda i: F.slice("at", F.lit(1), i))).alias("open"))
    stacks = prefixes.join(hosts.select(F.col("at").alias("open")), "open").groupBy("at").agg(
        F.array_sort(F.collect_list("open")).alias("stack"))
    # The next label in sort order after the interval of x is x followed by the lowest character.
    after = F.concat(F.slice("at", F.lit(1), F.size("at") - 1),
                     F.array(F.concat(F.element_at("at", -1), F.lit("\u0000"))))
    domain = F.col("at")[0].alias("domain")
    return stacks.select(domain, "at", F.lit(1).alias("kind"), "stack").union(stacks.select(
        domain, after.alias("at"), F.lit(0).alias("kind"),
        F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack")))


def path_events(rules: DataFrame) -> DataFrame:
    """Events (rule_at, at, kind, top) of the paths of each rule host; top is the innermost rule.

    Paths are compared as hexadecimal text, so ``G`` ends an interval. The running sum of opened
    and closed intervals is the depth of the stack; what a closing event returns to is the last
    rule opened at its depth.
    """
    own = rules.select(labels(F.col("rule_host")).alias("rule_at"), F.hex("rule_path").alias("p"),
                       F.struct("rule_host", "rule_path", "action").alias("rule"))
    events = own.select("rule_at", F.col("p").alias("at"), F.lit(1).alias("kind"), "rule").union(
        own.select("rule_at", F.concat("p", F.lit("G")).alias("at"), F.lit(0).alias("kind"), "rule"))
    depth = F.sum(F.col("kind") * 2 - 1).over(Window.partitionBy("rule_at").orderBy("at"))
    sweep = Window.partitionBy("rule_at", "depth").orderBy("at")
    return events.withColumn("depth", depth).select(
        "rule_at", "at", "kind", F.when(F.col("depth") > 0, F.last(
            F.when(F.col("kind") == 1, F.col("rule")), ignorenulls=True).over(sweep)).alias("top"))


def sweep(urls: DataFrame, events: DataFrame, shard: str, state: str) -> DataFrame:
    """Adds the column ``state`` of the last event at or before ``at`` within the shard key.

    Both sides have the columns ``shard`` and ``at``; events have ``kind`` and ``state``.
    """
    total = urls.count()
    hot = F.broadcast(hot_keys(urls, [shard], SHARE).select(
        F.col(shard).alias("hot_key"),
        F.ceil(F.col("n_rows") / max(1, SHARE * total)).cast("int").alias("shards")))
    join = lambda df: df.join(hot, F.col(shard).eqNullSafe(F.col("hot_key")), "left").withColumn(
        "shards", F.coalesce("shards", F.lit(1))).drop("hot_key")
    rows = join(urls).withColumn("salt", F.expr("cast(pmod(xxhash64(page_id, url), shards) as int)"))
    marks = join(events).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    both = rows.select("*", F.lit(2).alias("kind"), F.lit(None).cast(
        events.schema[state].dataType).alias(state)).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(shard, "salt").orderBy("at", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    held = F.last(F.when(F.col("kind") < 2, F.struct(F.col(state).alias("is"))), ignorenulls=True)
    return both.withColumn("held", held.over(order)).filter("kind = 2").drop(
        "shards", "salt", "kind", state).withColumn(state, F.col("held")["is"]).drop("held")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``pages`` has page_id and url, ``rules`` has host, path and action (allow or block). A rule
    fits its host and all subdomains if the path starts with its path; the longest rule (host and
    path together, then the longer host) wins; of equal rules block wins. Without a fitting rule
    the verdict is ``default`` and the rule null. Null urls and those without ``://`` have an
    empty host and path. Rules with a null in any column are skipped. Other columns of ``pages``
    are not read, so they cannot clash.
    """
    rules = rules.filter("host is not null and path is not null and action is not null").groupBy(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")
        ).agg(F.max("action").alias("action"))
    url = F.col("url")
    urls = pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies")).select(
        "page_id", "url", "copies", host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = urls.withColumn("at", labels(F.col("host"))).withColumn("domain", F.col("at")[0])
    placed = cut(sweep(keyed, host_events(rules), "domain", "stack").drop("at", "domain"))
    probes = placed.select("page_id", "url", "host", "path", "copies",
                           F.explode("stack").alias("rule_at"), F.hex("path").alias("at"))
    found = sweep(probes, path_events(rules), "rule_at", "top").filter("top is not null")
    size = F.length("top.rule_host") + F.length("top.rule_path")
    best = found.groupBy("page_id", "url").agg(F.max_by(
        "top", F.struct(size, F.length("top.rule_host"))).alias("best")).select(
        F.col("page_id").alias("best_page"), F.col("url").alias("best_url"), "best")
    same = F.col("page_id").eqNullSafe(F.col("best_page")) & F.col("url").eqNullSafe(
        F.col("best_url"))
    rows = placed.join(best, same, "left").select(
        "page_id", "host", "path", "best",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("page_id", "host", "path", F.concat("best.rule_host", "best.rule_path")
                       .alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


#: The rules of the registered query: fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    text = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in rules)
    return spark.sql(f"SELECT * FROM VALUES {text} AS v(host, path, action)")
