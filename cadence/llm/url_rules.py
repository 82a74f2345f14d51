"""URL filters: fixed (host, path) rules, and association rules mined from labelled URLs.

A URL's tokens are its scheme, the labels of its host and their words, the words of its path and
fragment, and the keys of its query; a word that starts with a digit counts by that digit.
Spark's FP-growth mines the token combinations of labelled URLs together with their label. Rules
{tokens} -> label are kept by support and confidence, and dropped where a rule with fewer of the
same tokens and the same label has at least their confidence.

Tokens of exactly the same URLs are one item (no combination tells them apart). FP-growth gets a
support threshold so high that no URL holds more than MAX_ITEMS frequent items, so a URL has at most
2**MAX_ITEMS combinations there. The rules between ``min_support`` and that threshold are found exactly
by growing combinations item by item (``_grown``), only along those that a kept rule can be built on.

To judge, each rule is posted under its rarest token, a URL looks up its own tokens there and the
rules found are verified on all their tokens. The best one (confidence, then support, then more
tokens, then block before allow, then the tokens in order) gives the verdict; a URL without a rule
gets ``default``.

Defined results: host and path of a null URL or one without :// are empty; a fixed rule never fits
an empty host. No usable labels, or labels of one kind only, mine what they hold; without any rule
every URL gets the default. Repeated rows give repeated rows and count as labels each, null ids are
ids like others, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.llm.store import stored

#: Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ALLOW, BLOCK = "allow", "block"
MIN_SUPPORT = 0.002  # share of the labelled URLs
MIN_URLS = 10  # labelled URLs that a rule needs at least
MIN_CONFIDENCE = 0.8
MAX_ITEMS = 14  # frequent items of a URL up to which FP-growth takes all of their combinations
BROADCAST_ROWS = 20_000  # rules or items, counted; more of them are joined by shuffle
COPIES = 10_000  # equal baskets that one task spells out
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Longest rule that fits, as struct(rule, verdict); null if none does."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL, each with the letter of its place."""
    def words(text: Column, place: str) -> Column:
        found = F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != "")
        kind = lambda w: F.when(w.rlike("^[0-9]"), F.concat(F.lit("#"), F.substring(w, 1, 1))).otherwise(w)
        return F.transform(found, lambda w: F.concat(F.lit(f"{place}:"), kind(w)))

    url = F.coalesce(url, F.lit(""))
    host = host_of(url)
    labels = F.transform(F.filter(F.split(host, r"\."), lambda w: w != ""), lambda w: F.concat(F.lit("h:"), w))
    last = F.transform(F.filter(F.array(F.regexp_extract(host, r"([^.]+)$", 1)), lambda w: w != ""), lambda w: F.concat(F.lit("t:"), w))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda w: w != ""), lambda w: F.concat(F.lit("q:"), F.split(w, "=")[0]))
    fragment = F.regexp_extract(url, r"#(.*)$", 1)
    scheme = F.transform(F.filter(F.array(F.regexp_extract(url, r"^([^:/?#]*)://", 1)), lambda w: w != ""), lambda w: F.concat(F.lit("s:"), w))
    return F.array_distinct(F.concat(scheme, labels, last, words(host, "w"), words(path_of(url), "p"), keys, words(fragment, "f")))


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "verdict", min_support: float = MIN_SUPPORT,
         min_urls: int = MIN_URLS, min_confidence: float = MIN_CONFIDENCE, max_items: int | None = None) -> DataFrame:
    """Return the mined rules: tokens array<string> (sorted), verdict, support long (URLs), confidence, rarest.

    Reads every labelled URL (label allow or block; other rows are not labels). ``max_items``: a caller's own
    bound, by which the support threshold rises until no URL holds more frequent items; None leaves none out.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    schema = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("verdict", T.StringType()),
                           T.StructField("support", T.LongType()), T.StructField("confidence", T.DoubleType()),
                           T.StructField("rarest", T.StringType())])
    # equal token sets of a label travel as one row with their number until the mining itself
    sets = (labelled.filter(F.col(label_col).isin(ALLOW, BLOCK))
            .select(F.col(label_col).alias("verdict"), F.array_sort(tokens_of(F.col(url_col))).alias("tokens"))
            .groupBy("verdict", "tokens").agg(F.count("*").alias("n")))
    sets = stored(sets.withColumn("k", F.xxhash64("verdict", "tokens")), "urls")
    total = sets.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], schema)
    least = max(1, min_urls, int(-(-total * min_support // 1)))
    # tokens of the same URLs: equal counts and equal sums of the rows' hashes (two independent ones)
    one = sets.select("n", "k", F.explode("tokens").alias("token"))
    items = (one.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("rows"),
                                      F.sum(F.col("k").cast("decimal(38,0)")).alias("h"),
                                      F.sum(F.xxhash64("k", F.lit(1)).cast("decimal(38,0)")).alias("h2"))
             .filter(F.col("n") >= least))
    items = stored(items.groupBy("n", "rows", "h", "h2")
                   .agg(F.min("token").alias("item"), F.array_sort(F.collect_set("token")).alias("tokens")), "items")
    # at most total * (mean tokens of a URL) / least items are frequent
    counts = items.select("item", F.col("n").alias("items_n"))
    if items.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    frequent = stored(one.select("k", F.col("token").alias("item")).join(counts, "item")
                      .groupBy("k").agg(F.reverse(F.array_sort(F.collect_list(F.struct("items_n", "item")))).alias("items")), "sets")
    bound, asked = MAX_ITEMS if max_items is None else max_items, least
    crowded = frequent.filter(F.size("items") > bound).agg(F.max(F.col("items")[bound]["items_n"])).first()[0]
    least = max(least, (crowded or 0) + 1)
    baskets = (sets.join(frequent, "k", "left")
               .select("n", F.concat(F.array(F.concat(F.lit("="), "verdict")),
                                     F.coalesce(F.transform(F.filter("items", lambda i: i["items_n"] >= least), lambda i: i["item"]),
                                                F.array().cast("array<string>"))).alias("items"))
               .groupBy("items").agg(F.sum("n").alias("n"))
               .select("items", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("i"))
               .repartition(F.xxhash64("items", "i"))
               .select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("i") * COPIES)))))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / total), minConfidence=min_confidence).fit(baskets.select("items"))
    sets_found = stored(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "combinations")
    label = lambda v: F.array(F.lit(f"={v}"))
    both = None
    for v in (ALLOW, BLOCK):
        part = (sets_found.filter(F.array_contains("items", f"={v}") & (F.size("items") > 1))
                .select(F.array_except("items", label(v)).alias("items"), F.lit(v).alias("verdict"), F.col("freq").alias("support")))
        both = part if both is None else both.unionByName(part)
    rules = (both.join(sets_found, "items").withColumn("confidence", F.col("support") / F.col("freq")).drop("freq")
             .filter(F.col("confidence") >= min_confidence))
    rules = stored(rules.withColumn("id", F.xxhash64("items", "verdict")), "mined")
    # a rule goes when another has a proper subset of its items, its label and no lower confidence;
    # the smaller rule is found by its items, subset by subset (at most 2**max_items)
    shorter = (rules.filter(F.size("items") > 1)
               .select("id", "verdict", "confidence", F.explode(_subsets(F.col("items"))).alias("items"))
               .join(rules.select("items", "verdict", F.col("confidence").alias("c")), ["items", "verdict"])
               .filter("c >= confidence").select("id").distinct())
    kept = rules.join(shorter, "id", "left_anti")
    if max_items is None and least > asked:
        weighed = (sets.join(frequent, "k").groupBy(F.array_sort(F.transform("items", lambda i: i["item"])).alias("items"))
                   .agg(*(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in (ALLOW, BLOCK))))
        rest = _grown(stored(weighed, "weighed"), asked, min_confidence).filter(F.col("support") < least)
        kept = stored(kept.unionByName(rest.withColumn("id", F.xxhash64("items", "verdict"))), "kept")
    tokens = (kept.select("id", F.explode("items").alias("item")).join(items, "item")
              .groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"),
                                 F.min(F.struct("n", "item")).alias("r")))
    return stored(kept.join(tokens, "id").select("tokens", "verdict", "support", "confidence", F.col("r.item").alias("rarest")), "rules")


def _grown(baskets: DataFrame, least: int, min_confidence: float) -> DataFrame:
    """All rules (items, verdict, support, confidence) of at least ``least`` URLs that no smaller rule makes needless.

    ``baskets``: sorted items, and how many URLs of each verdict hold just them. A combination grows by one later item a
    round, for as long as it has the support and fewer URLs of the other verdict than each combination without one
    of its items. Without that, leaving the item out gives at least the confidence, here and in all that is grown
    from it, so no rule is lost; ``best`` is the highest confidence of all smaller combinations. A round is one
    join of its combinations' baskets with the items, whatever the number of items in a URL.
    """
    other = {ALLOW: BLOCK, BLOCK: ALLOW}
    sides = F.explode(F.array(*(F.struct(F.lit(v).alias("verdict"), F.col(v).alias("hits"), F.col(o).alias("misses"))
                                for v, o in other.items()))).alias("s")
    base = stored(baskets.withColumn("basket", F.monotonically_increasing_id()).select("basket", "items", sides).select("basket", "items", "s.*"), "baskets")
    counted = lambda held: (held.groupBy("verdict", "set").agg(F.sum("hits").alias("support"), F.sum("misses").alias("misses"))
                            .filter(F.col("support") >= least).withColumn("confidence", F.col("support") / (F.col("support") + F.col("misses"))))
    held = base.select("verdict", "basket", "hits", "misses", F.explode("items").alias("item")).withColumn("set", F.array("item"))
    level = stored(counted(held).withColumn("best", F.lit(-1.0)), "level")
    single = level.filter("misses > 0").select("verdict", F.col("set")[0].alias("item"))  # others make needless all they are part of
    use = stored(held.join(single, ["verdict", "item"]).drop("set"), "items_used")
    found, held = level, use.withColumn("set", F.array("item"))
    while True:
        longer = stored(held.select("verdict", "basket", "set", F.col("item").alias("last"))
                        .join(use, ["verdict", "basket"]).filter(F.col("item") > F.col("last"))
                        .withColumn("set", F.concat("set", F.array("item"))).drop("last"), "longer")
        new = counted(longer)
        without = F.explode(F.transform("set", lambda i: F.array_remove("set", i))).alias("part")
        parts = (new.select("verdict", "set", without)
                 .join(level.select("verdict", F.col("set").alias("part"), F.col("misses").alias("part_misses"),
                                    F.greatest("best", "confidence").alias("part_best")), ["verdict", "part"])
                 .groupBy("verdict", "set").agg(F.count("*").alias("parts"), F.min("part_misses").alias("fewest"), F.max("part_best").alias("best")))
        level = stored(new.join(parts, ["verdict", "set"]).filter((F.col("parts") == F.size("set")) & (F.col("misses") < F.col("fewest")))
                       .drop("parts", "fewest"), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
        held = longer.join(level.filter("misses > 0").select("verdict", "set"), ["verdict", "set"])
    return (found.filter((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("best")))
            .select(F.col("set").alias("items"), "verdict", "support", "confidence"))


def _subsets(items: Column) -> Column:
    """All non-empty proper subsets of a short sorted array, each sorted."""
    empty = F.array(F.array().cast("array<string>"))
    grown = F.aggregate(items, empty, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    return F.filter(grown, lambda s: (F.size(s) > 0) & (F.size(s) < F.size(items)))


def judge(pages: DataFrame, mined: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          default: str = ALLOW) -> DataFrame:
    """Return page_id, host, path, rule, verdict, and the mined rule behind it: why array<string>, confidence."""
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules)).withColumn("row", F.monotonically_increasing_id())
    index = mined.select(F.col("rarest").alias("token"), F.struct(
        "confidence", "support", F.size("tokens").alias("size"), (F.col("verdict") == BLOCK).alias("block"),
        F.col("tokens").alias("why")).alias("found"))
    tokens = F.when(F.col("fixed").isNull(), tokens_of(F.col("url")))
    rows = base.select("row", "page_id", "host", "path", "fixed", tokens.alias("tokens"))
    if mined.count() <= BROADCAST_ROWS:  # a URL keeps its tokens that rules use
        index = F.broadcast(index)
        used = mined.select(F.explode("tokens").alias("t")).agg(F.collect_set("t").alias("used"))
        rows = rows.crossJoin(F.broadcast(used)).withColumn("tokens", F.array_intersect("tokens", "used")).drop("used")
    hits = rows.select("*", F.explode_outer("tokens").alias("token")).join(index, "token", "left")
    fits = F.size(F.array_except("found.why", "tokens")) == 0
    best = (hits.groupBy("row").agg(*(F.first(c).alias(c) for c in ("page_id", "host", "path", "fixed")),
                                    F.max(F.when(fits, F.col("found"))).alias("found")))
    verdict = (F.when(F.col("fixed").isNotNull(), F.col("fixed.verdict"))
               .when(F.col("found").isNull(), F.lit(default)).when(F.col("found.block"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return best.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"),
                       F.col("found.why").alias("why"), F.col("found.confidence").alias("confidence"))


def labelled_by_rules(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """URLs that a fixed rule decides, with its verdict: labels where no others are given."""
    url = F.col(url_col).cast("string")
    fixed = fixed_rule(host_of(url), path_of(url), rules)
    return pages.select(url.alias("url"), fixed["verdict"].alias("verdict")).filter("verdict IS NOT NULL")


def filter_urls(pages: DataFrame, **settings) -> DataFrame:
    """Judge the URLs by rules mined from all labels; a ``max_items`` setting leaves rules of low support out (see ``mine``)."""
    return judge(pages, mine(labelled_by_rules(pages), **settings))
