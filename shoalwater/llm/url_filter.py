"""URL filters: a Bloom filter cascade that is exact on the corpus's own keys.

DataFrame operations only. A key is a host or one of its parent domains followed by a
prefix of the path (``example.net/en/``). The key universe is every key of the corpus, so the first
filter, over the listed keys, has known false positives; the second filter encodes those,
the third the listed keys that the second wrongly holds, and so on until a level has none. A
key is listed if the first filter that lacks it is an even one (counting from 1). The filters
are literals in the plan: judging needs no join. Long lists are dealt by a hash of the key to
parts of a bounded size, each with cascades of its own, and the pages are judged part by part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import pin, table

#: Rules as (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts that the method blocks where no rule fits, as (action, host, path).
LISTED = (("block", "spam-farm.example.org", "/"), ("block", "spam-farm.example.com", "/"))
#: Bits that the filters of one pass over the pages are to have; longer lists take more passes.
MAX_BITS = 1 << 24
#: Bits of a byte in a filter's literal: bytes stay below 128, so that each is one character.
BITS = 7


def host_of(url) -> Column:
    """Lower-cased (A-Z) text between the first `://` and `/`, `?`, `#` or the end."""
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url) -> Column:
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after_scheme(url) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def keys_of(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys of a URL: each suffix of labels with each prefix of the path of a given length."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]), lambda p: p.isNotNull())
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def _positions(key: Column, level: int, m: int, k: int) -> list[Column]:
    a, b = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(m)), F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(max(1, m - 1))) + 1
    return [F.pmod(a + F.lit(i) * b, F.lit(m)) for i in range(k)]


def _build(keys: DataFrame, n: int, level: int, rate: float) -> tuple[str, int, int]:
    """A filter over ``keys``: its bytes in hex, its bits and its hash functions.

    The set bits are combined on the map side by byte of the filter; what reaches the driver is
    the filter, whose size ``parts_for`` keeps near ``MAX_BITS``.
    """
    k = max(1, round(math.log2(1 / rate)))
    m = max(64, math.ceil(n * k / math.log(2)))
    bits = keys.select(F.explode(F.array(*_positions(F.col("key"), level, m, k))).alias("p"))
    per_byte = bits.groupBy(F.floor(F.col("p") / BITS).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("p", F.lit(BITS)).cast("int"))).alias("b"))
    data = bytearray(math.ceil(m / BITS))
    for r in per_byte.collect():
        data[r["at"]] = r["b"]
    return data.hex(), m, k


def _holds(level: int, bits: tuple[str, int, int], key: Column) -> Column:
    data, m, k = bits
    literal = F.expr(f"X'{data}'")
    found = None
    for p in _positions(key, level, m, k):
        byte = F.ascii(F.substring(literal, (F.floor(p / BITS) + 1).cast("int"), F.lit(1)).cast("string"))
        hit = F.getbit(byte, F.pmod(p, F.lit(BITS)).cast("int")) == 1
        found = hit if found is None else found & hit
    return found


class Cascade:
    """Exact membership of the universe's keys in a list, as a Column without joins.

    ``universe`` and ``listed``: DataFrames of one column, key. Both may hold repeats and
    nulls; a null key is in no list. An empty list holds nothing.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame):
        both = universe.select("key", F.lit(0).alias("l")).union(listed.select("key", F.lit(1).alias("l"))).where("key IS NOT NULL").groupBy("key").agg(F.max("l").alias("l"))
        size = both.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("in"), F.coalesce(F.sum(1 - F.col("l")), F.lit(0)).alias("out")).first()
        n, rest = int(size["in"]), int(size["out"])
        self.levels: list[tuple[str, int, int]] = []
        if not n:
            return
        inside, outside = listed.where("key IS NOT NULL").distinct(), None
        rate = max(1e-9, min(0.5, n / max(1, rest) / math.sqrt(2)))
        while n:
            level = len(self.levels)
            self.levels.append(_build(inside, n, level, rate))
            held = _holds(level, self.levels[-1], F.col("key"))
            # the first level's false positives are found in one pass over the universe
            wrong = pin((both.where("l = 0") if outside is None else outside).where(held).select("key"), "cascade")
            inside, outside, n, rate = wrong, inside, wrong.count(), 0.5

    def contains(self, key: Column) -> Column:
        if not self.levels:
            return F.lit(False)
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(_holds(i, self.levels[i], key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def parts_for(universe: DataFrame, lists: list[DataFrame], max_bits: int) -> int:
    """Parts of the key space whose cascades have about ``max_bits`` bits together.

    A first level takes log2(outside / inside) hash functions, the later ones about three bits a key.
    """
    outside, bits = max(1, universe.count()), 0.0
    for df in lists:
        n = df.where("key IS NOT NULL").distinct().count()
        if n:
            bits += n * (max(1.0, math.log2(outside / n) + 0.5) / math.log(2) + 3)
    return max(1, math.ceil(bits / max_bits))


def judge(pages: DataFrame, rules: DataFrame, path_lengths: list[int], listed: DataFrame | None = None, default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url).

    ``rules`` and ``listed``: (action, key) with action block or allow and key host + path.
    ``path_lengths``: the lengths of the keys' paths. The longest fitting rule gives rule and
    verdict; else the longest fitting listed key gives the verdict with a null rule; else
    ``default``. Null urls and urls without `://` have empty host and path and fit nothing.
    A key that is both blocked and allowed blocks. Urls of any length are judged whole. Only page_id and url are read, so other
    columns may have any name. Repeated rows give repeated results; an empty table gives an empty one. Lists of over
    ``max_bits`` bits of filters take one pass over the pages for each part of the keys.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    best = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), path_lengths))
    lists = {"rule": rules, "listed": listed} if listed is not None else {"rule": rules}
    # pinned: every cascade and each of its levels reads the keys, the pages are read once
    universe = pin(best.select(F.explode("keys").alias("key")).distinct(), "universe")
    parts = parts_for(universe, list(lists.values()), max_bits)

    def longest(cascades: dict, name: str, action: str, part) -> Column:
        found = F.filter("keys", lambda k: part(k) & cascades[name, action].contains(k))
        return F.coalesce(F.array_max(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(action).alias("action")))), nothing)

    nothing = F.struct(F.lit(-1).alias("n"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("action"))
    for i in range(parts):
        part = (lambda k, i=i: F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(parts)) == i) if parts > 1 else (lambda k: F.lit(True))
        cascades = {(name, action): Cascade(universe.where(part(F.col("key"))), df.where((F.col("action") == action) & part(F.col("key"))).select("key")) for name, df in lists.items() for action in ("block", "allow")}
        for name in lists:
            before = [F.col(f"_{name}")] if i else []
            best = best.withColumn(f"_{name}", F.greatest(*before, longest(cascades, name, "block", part), longest(cascades, name, "allow", part)))
        if i + 1 < parts:  # a plan holds the filters of one part only
            best = pin(best, "judged")
    return best.select("page_id", "host", "path", F.col("_rule.key").alias("rule"), F.coalesce(*[F.col(f"_{name}.action") for name in lists], F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h + p).alias("key")) for a, h, p in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    lengths = sorted({len(p) for _, _, p in RULES + LISTED})
    return judge(pages, rule_table(spark, RULES), lengths, rule_table(spark, LISTED))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' AS net, (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' AS net_en,
  (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' AS com_de, (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' AS org_fr,
  (host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org' OR host = 'spam-farm.example.com' OR host LIKE '%.spam-farm.example.com') AND path LIKE '/%' AS listed FROM s)
SELECT page_id, host, path, CASE WHEN net_en THEN 'example.net/en/' WHEN com_de THEN 'example.com/de/' WHEN org_fr THEN 'org/fr/' WHEN net THEN 'net/' END AS rule,
  CASE WHEN net_en THEN 'allow' WHEN com_de THEN 'block' WHEN org_fr THEN 'allow' WHEN net OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
