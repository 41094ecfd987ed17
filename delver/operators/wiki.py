"""Link mentions, categories, redirects and name features from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delver.functions.text import tokens


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, ref, surface) of every anchor."""
    found = F.regexp_extract_all("html", F.lit(r'(<a href="[^"]*">[^<]*</a>)'), F.lit(1))
    m = pages.where("html is not null").select("page_id", F.posexplode(found).alias("pos", "m"))
    return m.select("page_id", "pos", F.regexp_extract("m", 'href="([^"]*)"', 1).alias("ref"), F.regexp_extract("m", ">([^<]*)<", 1).alias("surface"))


def neighbours(mention: DataFrame) -> DataFrame:
    """mention with the surfaces left and right of it on the page ('' at a border)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("page_id").orderBy("pos")
    return mention.withColumn("left", F.coalesce(F.lag("surface").over(w), F.lit(""))).withColumn("right", F.coalesce(F.lead("surface").over(w), F.lit("")))


def categories(pages: DataFrame) -> DataFrame:
    """(page_id, category): first path element of the page's address; titles with a colon are skipped."""
    ok = pages.where(~F.regexp_extract("html", "<title>([^<]*)", 1).contains(":"))
    return ok.select("page_id", F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1).alias("category")).where("category <> ''")


def typed(cats: DataFrame, types: dict[str, str]) -> DataFrame:
    """(page_id, type): the first matching type in the order given."""
    order = list(types)
    expr = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(order))):
        expr = F.when(F.col("category").rlike(types[t]), i).otherwise(expr)
    best = cats.select("page_id", expr.alias("k")).where("k is not null").groupBy("page_id").agg(F.min("k").alias("k"))
    return best.select("page_id", F.element_at(F.array(*map(F.lit, order)), F.col("k") + 1).alias("type"))


def surfaces(mention: DataFrame) -> DataFrame:
    """(surface, n, n_pages, refs)."""
    return mention.groupBy("surface").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"), F.countDistinct("ref").alias("refs"))


def features(mention: DataFrame) -> DataFrame:
    """(surface, feature, value): first/last character, first/last two, shares of neighbours, min(len / 10, 1)."""
    m = mention.where("surface <> ''")
    size = F.length("surface")
    s = m.select("surface").distinct()
    fixed = F.array(
        F.struct(F.concat(F.lit("first:"), F.substring("surface", 1, 1)).alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.concat(F.lit("last:"), F.expr("substr(surface, -1)")).alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.concat(F.lit("first2:"), F.substring("surface", 1, 2)).alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.concat(F.lit("last2:"), F.expr("CASE WHEN length(surface) < 2 THEN surface ELSE substr(surface, -2) END")).alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.lit("length").alias("feature"), F.least(size / 10.0, F.lit(1.0)).alias("value")),
    )
    out = s.select("surface", F.explode(fixed).alias("f")).select("surface", "f.feature", "f.value")
    total = m.groupBy("surface").agg(F.count("*").alias("n"))
    for side in ("left", "right"):
        c = m.where(F.col(side) != "").groupBy("surface", side).agg(F.count("*").alias("c")).join(total, "surface")
        out = out.union(c.select("surface", F.concat(F.lit(f"{side}:"), side), F.col("c") / F.col("n")))
    return out


def libsvm(feature: DataFrame) -> DataFrame:
    """(surface, line): features as index:value in index order; indexes are dense ranks of feature names."""
    from pyspark.sql import Window as W

    names = feature.select("feature").distinct().withColumn("p", F.substring("feature", 1, 9))
    sizes = names.groupBy("p").agg(F.count("*").alias("n"))  # only prefixes are ranked in one task
    before = sizes.select("p", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    at = names.join(before, "p").select("feature", (F.row_number().over(W.partitionBy("p").orderBy("feature")) + F.col("o")).alias("i"))
    items = F.array_sort(F.collect_list(F.struct("i", F.format_number("value", 4).alias("v"))))
    return feature.join(at, "feature").groupBy("surface").agg(F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["i"].cast("string"), x["v"])), " ").alias("line"))


def title_tokens(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", tokens(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("terms"))


def markup_categories(pages: DataFrame) -> DataFrame:
    """(title, category) of `[[Category:name|key]]` in pages(title, text); titles with a colon are skipped."""
    found = F.regexp_extract_all("text", F.lit(r"(?i)\[\[\s*category\s*:\s*([^\]|]+)"), F.lit(1))
    return pages.where(~F.col("title").contains(":")).select("title", F.explode(found).alias("category")).select("title", F.trim("category").alias("category"))


def markup_links(pages: DataFrame, width: int = 1) -> DataFrame:
    """(title, pos, ref, surface, left, right) of `[[target|surface]]`, with `width` terms on either side; redirect pages and links with a colon are skipped."""
    parts = F.split("text", r"\[\[")
    rows = pages.where(~F.upper("text").startswith("#REDIRECT")).select("title", parts.alias("parts"), F.posexplode(parts).alias("pos", "part")).where("pos > 0 and part like '%]]%'")
    inner, after = F.substring_index("part", "]]", 1), F.expr("substring(part, instr(part, ']]') + 2)")
    before = F.expr("get(parts, pos - 1)")
    before = F.when(before.contains("]]"), F.expr("substring(get(parts, pos - 1), instr(get(parts, pos - 1), ']]') + 2)")).otherwise(before)
    join = lambda a: F.array_join(a, " ")
    out = rows.select("title", "pos", F.trim(F.substring_index(inner, "|", 1)).alias("ref"), F.trim(F.substring_index(inner, "|", -1)).alias("surface"), join(F.slice(F.reverse(tokens(before)), 1, width)).alias("left"), join(F.slice(tokens(after), 1, width)).alias("right"))
    return out.where(~F.col("ref").contains(":"))


def propagate_types(types: DataFrame, redirects: DataFrame, order: list[str]) -> DataFrame:
    """(entity, type): types(entity, type), also given to redirects(title, target) of an entity; the first type in the order wins."""
    more = redirects.join(types.select(F.col("entity").alias("target"), "type"), "target").select(F.col("title").alias("entity"), "type")
    ranked = types.select("entity", "type").union(more).withColumn("k", F.array_position(F.array(*map(F.lit, order)), F.col("type"))).where("k > 0")
    return ranked.groupBy("entity").agg(F.min("k").cast("int").alias("k")).select("entity", F.element_at(F.array(*map(F.lit, order)), F.col("k")).alias("type"))


def libsvm_of_class(feature: DataFrame, typed: DataFrame, kind: str, negative: float = 1.0) -> DataFrame:
    """(surface, label, line): 1 for surfaces of the class, -1 for a hashed share `negative` of the others."""
    lines = libsvm(feature).join(typed.where(F.col("type") == kind).select("surface", F.lit(1).alias("label")), "surface", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    return lines.where((F.col("label") == 1) | (F.pmod(F.xxhash64("surface"), F.lit(1 << 30)) < F.lit(int(negative * (1 << 30))))).select("surface", "label", "line")
