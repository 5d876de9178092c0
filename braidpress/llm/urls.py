"""URL rules by expression expansion.

Each URL is expanded into host-suffix and path-prefix expressions, as lookup lists on the Web do. The
expressions are joined to the rules on a short prefix of their digest; full digests then confirm, and the
longest rule wins. Rows are joined, never collected; the rule side is small in most uses, but the plan works for
any number of rules, since Spark chooses the join by size.

A URL is expanded no further than the rules reach (labels of a host, slashes of a path), so a very long one
costs no more than others. Rows without a host go round the joins.

Results by case: a null URL, or one without ``://``, has an empty host and path and no rule; a URL without a
fitting rule gets the default verdict; of rules of one length that fit, which differ in host and path, the
longer host wins, and of equal rules with other actions ``block`` wins; repeated rows each get a row; extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWERED)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def expressions(host: Column, path: Column, most_labels: int, most_slashes: int) -> Column:
    """All ``host suffix`` + newline + ``path prefix`` strings; prefixes end at a slash or are empty.

    Suffixes have ``most_labels`` labels and prefixes ``most_slashes`` slashes at most.
    """
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most_labels + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path, "/", most_slashes + 1)  # the last part has whatever follows
    paths = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))).otherwise(F.array(F.lit("")))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("\n"), p)))))


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, ``rule`` and ``verdict`` of every row.

    ``rules`` has ``host``, ``path`` and ``action`` (allow or block). A rule's path may end anywhere: it is filed
    under its part up to the last slash, and the rest is compared after the join.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    src = urls.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    r = rules.select(
        F.translate(F.col("host"), UPPER, LOWERED).alias("rule_host"),
        F.coalesce(F.col("path"), F.lit("")).alias("rule_path"),
        F.col("action"),
    ).where(F.col("rule_host") != "")
    filed = F.regexp_extract("rule_path", r"(?s)^.*/", 0)
    r = r.withColumn("rule_digest", F.sha2(F.concat("rule_host", F.lit("\n"), filed), 256)).withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    count = lambda c, mark: F.coalesce(F.max(F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))), F.lit(0))
    dots, slashes = r.agg(count(F.col("rule_host"), "."), count(F.col("rule_path"), "/")).first()
    named, nameless = src.where("host != ''"), src.where("host = ''")
    pairs = named.select("host", "path").distinct()
    wide = pairs.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), dots + 1, slashes)).alias("e")).select("host", "path", F.sha2("e", 256).alias("digest"))
    hits = (
        wide.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
        .join(r, "short")
        .where((F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    )
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("total"),
        F.length("rule_host").alias("wide"),
        F.when(F.col("action") == "block", 1).otherwise(0).alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("action"),
    )
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = named.join(best, ["host", "path"], "left").select("key", "host", "path", "best.rule", "best.action")
    out = out.unionByName(nameless, allowMissingColumns=True)
    return out.select(
        F.col("key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("action", F.lit(default)).alias("verdict"),
    )
