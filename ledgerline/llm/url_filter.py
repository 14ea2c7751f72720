"""URL filter: a blocked Bloom filter of listed keys lets possible hits pass to an exact hash
join, which removes its false positives.

A list row has (kind, host, path, action). kind `rule` fits a host and all its subdomains
when the path begins with the rule's path; kind `url` fits one canonical URL. Keys are
host + path for rules. For a page URL the keys it could hit are: its canonical URL, and for
every shape (number of host labels, length of path) that occurs among the rules, the host's
last labels with that much of the path. The longest fitting rule decides; without a rule,
a listed canonical URL does; otherwise the URL is allowed.

The Bloom filter has blocks of 256 bits, eight words of 32; a key sets one bit in each word
of one block. The number of blocks follows the list, up to MAX_BLOCKS, so the broadcast
filter never exceeds MAX_BLOCKS rows of 72 bytes; a longer list only lets more false
positives through to the join. Distinct URLs are judged, so a hot host or page that repeats
is judged once; verdicts are joined back by URL.

Built-in functions only. Defined cases: a null URL, or one without `://`, has an empty host
and path, fits no rule and is allowed; repeated rows each get their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, stored

WORDS = 8
MAX_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 16

# Query parameters that do not change a page.
_TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.lit(2**31 - 1)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(raw), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host without a mirror label or default port, path without a closing slash, the
    parameters that matter in order; no scheme, no fragment."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    params = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING))
    )
    return F.concat(
        F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", ""),
        F.regexp_replace(path, r"/$", ""),
        F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""),
    )



def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bit_of(key: Column, word: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(word)), F.lit(32)).cast("int")


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the blocks that hold a key."""
    return keys.groupBy(block_of(F.col("key"), blocks).alias("block")).agg(
        *[
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit_of(F.col("key"), w))).alias(f"w{w}")
            for w in range(WORDS)
        ]
    )


def passing(candidates: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """Candidates all of whose bits are set. filter_blocks is bounded by MAX_BLOCKS rows."""
    test = F.lit(True)
    for w in range(WORDS):
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit_of(F.col("key"), w))
        test = test & (F.col(f"w{w}").bitwiseAND(bit) != 0)
    return (
        candidates.withColumn("block", block_of(F.col("key"), blocks))
        .join(F.broadcast(filter_blocks), "block")
        .where(test)
        .select(*candidates.columns)
    )


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """pages with columns host, path, rule (text of the deciding rule), listed (whether the
    canonical URL is on the list) and verdict (allow or block)."""
    keyed = stored(
        listed.select(
            F.concat_ws("|", "kind", F.concat("host", "path")).alias("key"),
            "kind", "host", "path", "action",
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("path_length"),
        ).where("key is not null").dropDuplicates(["key"]),
        "url-list",
    )
    blocks = max(1, min(max_blocks, keyed.count() // KEYS_PER_BLOCK + 1))
    shapes = [
        (r[0], r[1])
        for r in keyed.where("kind = 'rule'").select("labels", "path_length").distinct().collect()
    ]  # bounded: labels of a host name by lengths of a path

    host, path = host_and_path(F.col("url"))
    urls = (
        pages.select(F.col(f"`{url_col}`").alias("url")).where("url is not null").distinct()
        .select("url", host.alias("host"), path.alias("path"))
        .where("host <> '' or path <> ''")
    )
    keys = [F.concat(F.lit("url|"), canonical(F.col("url"), F.col("host"), F.col("path")))]
    for labels, length in shapes:
        keys.append(
            F.when(
                (F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= length),
                F.concat(
                    F.lit("rule|"),
                    F.expr(f"substring_index(host, '.', {-int(labels)})"),
                    F.substring("path", 1, int(length)),
                ),
            )
        )
    candidates = urls.select("url", F.explode(F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull()))).alias("key"))
    hits = passing(candidates, bloom(keyed.select("key"), blocks), blocks)
    exact = hits.join(keyed.hint("shuffle_hash"), "key")
    size = F.length("host") + F.length("path")
    best = exact.groupBy("url").agg(
        F.max(
            F.when(F.col("kind") == "rule", F.struct(size.alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), F.col("action").alias("action")))
        ).alias("rule"),
        F.max(F.when(F.col("kind") == "url", F.col("action"))).alias("url_action"),
    )
    host, path = host_and_path(F.col(f"`{url_col}`"))
    base = [F.col(f"p.`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict") or c == url_col]
    joined = pages.alias("p").join(best.alias("b"), F.col(f"p.`{url_col}`") == F.col("b.url"), "left")
    host, path = host_and_path(F.col(f"p.`{url_col}`"))
    return joined.select(
        *base,
        host.alias("host"),
        path.alias("path"),
        F.col("b.rule.rule").alias("rule"),
        F.col("b.url_action").isNotNull().alias("listed"),
        F.coalesce(F.col("b.rule.action"), F.col("b.url_action"), F.lit("allow")).alias("verdict"),
    )
