"""Content generation from catalogue rows, as batch jobs over all books:
ad copy, image prompts, colour palettes, recommendation sentences and
context lines. Templates are rendered with built-in string functions and
fanned out with ``posexplode`` (no Python per row)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import templates as T
from inkwell.operators.keys import with_group_heads

_BOOK_COLS = ["book_id", "title", "author", "genre", "price"]


def _variants(books: DataFrame, key: str, key_values: list[str], table: dict[str, list[str]],
              default: str, extra) -> DataFrame:
    """One row per (book, key value, template) with 1-based numbering."""
    items = []
    for kv in key_values:
        for i, t in enumerate(table.get(kv, table[default])):
            items.append(F.struct(F.lit(kv).alias(key), F.lit(i + 1).alias("n"),
                                  T.render(t).alias("text"), *extra(kv, i)))
    return books.select("book_id", F.explode(F.array(*items)).alias("v")).select("book_id", "v.*")


def check_allowed(values: list[str], allowed: list[str], what: str) -> list[str]:
    unknown = [v for v in values if v not in allowed]
    if unknown:
        raise ValueError(f"Invalid {what}: {', '.join(unknown)}")
    return values


def ad_copy(dim_books: DataFrame, ad_types: list[str] | None = None) -> DataFrame:
    """Variants per book and ad type. A type without templates of its own
    (print) uses the social ones; one that is not allowed is an error."""
    ad_types = check_allowed(ad_types or ["social_media", "email", "display"], T.AD_TYPES, "ad_type")

    def extra(kv, i):
        cta = T.AD_CALL_TO_ACTION["social_media" if kv == "social_media" else "other"]
        return [F.lit("template").alias("type"), F.lit(T.AD_CONFIDENCE).alias("confidence"),
                F.lit(cta).alias("call_to_action")]

    v = _variants(dim_books.select(*_BOOK_COLS), "ad_type", ad_types, T.AD_TEMPLATES, "social_media", extra)
    return v.select("book_id", "ad_type", F.col("n").alias("variant"), "text", "type", "confidence",
                    F.length("text").alias("length"), "call_to_action")


def ad_copy_dashboard(dim_books: DataFrame, ad_types: list[str] | None = None) -> DataFrame:
    """Dashboard table form: '#n', 'Template', '80%', length, CTA."""
    ad_types = check_allowed(ad_types or ["social_media", "email", "display"], T.AD_TYPES, "ad_type")
    books = dim_books.select(*_BOOK_COLS)

    def extra(kv, i):
        cta = T.DASHBOARD_CALL_TO_ACTION["social_media" if kv == "social_media" else "other"]
        return [T.render(cta).alias("call_to_action")]

    v = _variants(books, "ad_type", ad_types, T.DASHBOARD_AD_TEMPLATES, "social_media", extra)
    return v.select("book_id", "ad_type", F.concat(F.lit("#"), F.col("n").cast("string")).alias("variant"),
                    F.col("text").alias("ad_copy"), F.lit("Template").alias("type"),
                    F.lit("80%").alias("confidence"), F.length("text").alias("length"), "call_to_action")


def display_ad_copy(ads: DataFrame) -> DataFrame:
    """``ad_copy`` rows as shown for an answered request: title-cased type,
    confidence as a percentage with one decimal."""
    return ads.select("book_id", "ad_type", F.concat(F.lit("#"), F.col("variant").cast("string")).alias("variant"),
                      F.col("text").alias("ad_copy"), F.initcap("type").alias("type"),
                      F.concat(F.format_string("%.1f", F.col("confidence") * 100), F.lit("%")).alias("confidence"),
                      "length", "call_to_action")


def display_image_prompts(prompts: DataFrame) -> DataFrame:
    """``image_prompts`` rows as shown for an answered request: title-cased
    focus and style."""
    return prompts.select("book_id", F.concat(F.lit("#"), F.col("n").cast("string")).alias("prompt_no"),
                          F.col("prompt").alias("image_prompt"), F.initcap("focus").alias("focus"),
                          F.initcap("style").alias("style"), "length")


def display_recommendations(recommendations: DataFrame) -> DataFrame:
    """Recommended books as shown: title, genre, score and reason, with the
    texts used where one is missing."""
    names = recommendations.columns
    score = [F.col(c).cast("string") for c in ("confidence_score", "similarity_score") if c in names]
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in names else F.lit(default)
    return recommendations.select(
        text("title", "Unknown").alias("title"), text("genre", "Unknown").alias("genre"),
        F.coalesce(*score, F.lit("N/A")).alias("confidence_score"), text("reason", "Recommended").alias("reason"))


def ad_copy_summary(ads: DataFrame) -> DataFrame:
    """Variants and mean text length per book and ad type."""
    return ads.groupBy("book_id", "ad_type").agg(
        F.count(F.lit(1)).alias("variants"), F.avg("length").alias("avg_length"))


def image_prompts(dim_books: DataFrame, styles: list[str] | None = None) -> DataFrame:
    """Three prompts per style, focus cycling cover / typography / theme. A
    style without prompts of its own uses the modern ones; one that is not
    allowed is an error."""
    styles = check_allowed(styles or ["modern", "vintage", "dramatic"], T.IMAGE_STYLES, "style")

    def extra(kv, i):
        return [F.lit(T.PROMPT_FOCUS[i % 3]).alias("focus")]

    v = _variants(dim_books.select(*_BOOK_COLS), "style", styles, T.IMAGE_PROMPTS, "modern", extra)
    return v.select("book_id", "style", "n", F.col("text").alias("prompt"), "focus",
                    F.length("text").alias("length"))


def image_prompts_dashboard(dim_books: DataFrame, styles: list[str] | None = None) -> DataFrame:
    p = image_prompts(dim_books, styles)
    return p.select("book_id", F.concat(F.lit("#"), F.col("n").cast("string")).alias("prompt_no"),
                    F.col("prompt").alias("image_prompt"), F.lit("Template").alias("focus"),
                    F.initcap("style").alias("style"), "length")


def color_palette(dim_books: DataFrame) -> DataFrame:
    """Palette by lower-case genre from a literal map (no join)."""
    m = F.create_map(*[x for g, cs in T.GENRE_COLORS.items()
                       for x in (F.lit(g), F.array(*[F.lit(c) for c in cs]))])
    default = F.array(*[F.lit(c) for c in T.DEFAULT_COLORS])
    return dim_books.select("book_id", F.coalesce(m[F.lower(F.col("genre"))], default).alias("colors"))


def recommendation_text(dim_books: DataFrame, user_types: list[str] | None = None) -> DataFrame:
    user_types = user_types or ["academic", "casual", "general"]
    items = [F.struct(F.lit(u).alias("user_type"),
                      T.render(T.RECOMMENDATION_TEXT.get(u, T.RECOMMENDATION_TEXT["other"])).alias("text"))
             for u in user_types]
    return dim_books.select("book_id", F.explode(F.array(*items)).alias("r")).select("book_id", "r.*")


def same_genre_others(dim_books: DataFrame, k: int = 3) -> DataFrame:
    """For every book, the first k other books of its genre by id: the
    genre's first k+1, one short list, minus the book."""
    item = F.struct(F.col("book_id").alias("other_id"), F.col("title").alias("other_title"),
                    F.col("author").alias("other_author"))
    rows = with_group_heads(dim_books.select("book_id", "genre"), dim_books, "genre", [F.col("book_id")],
                            item, k + 1)
    own = F.slice(F.filter("_head", lambda x: x["other_id"] != F.col("book_id")), 1, k)
    return (rows.select("book_id", F.posexplode(own).alias("_p", "x"))
            .select("book_id", (F.col("_p") + 1).alias("pos"), "x.*"))


def same_genre_context(dim_books: DataFrame) -> DataFrame:
    """Titles of the first three same-genre books (a book alone in its
    genre gets an empty list)."""
    o = same_genre_others(dim_books, 3)
    titles = o.groupBy("book_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "other_title"))),
                    lambda s: s["other_title"]).alias("titles"))
    return (dim_books.select("book_id").join(titles, "book_id", "left")
            .select("book_id", F.coalesce("titles", F.array().cast("array<string>")).alias("titles")))


def book_context(dim_books: DataFrame, dim_publishers: DataFrame) -> DataFrame:
    """Context lines per book (inner join with its publisher), plus a
    'Similar books' line when the genre has other books."""
    p = dim_publishers.select("publisher_id", "publisher_name", "publisher_type")
    b = dim_books.select(*_BOOK_COLS, "publisher_id").join(p, "publisher_id")
    o = same_genre_others(dim_books, 3)
    sim = o.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", F.concat_ws(" by ", "other_title", "other_author").alias("s")))).alias("_s"))
    j = b.join(sim, "book_id", "left")
    base = F.array(*[T.render(t) for t in T.CONTEXT_LINES])
    similar = F.concat(F.lit(T.SIMILAR_PREFIX), F.array_join(F.transform("_s", lambda x: x["s"]), ", "))
    lines = F.when(F.col("_s").isNull(), base).otherwise(F.concat(base, F.array(similar)))
    return j.select("book_id", lines.alias("lines"))


def context_response(context: DataFrame, prompts: DataFrame) -> DataFrame:
    """Template answer from the first three context items and the first
    50 characters of the prompt; no context -> the short form."""
    j = prompts.join(context, "book_id", "left")
    ctx = F.array_join(F.slice(F.coalesce("lines", F.array().cast("array<string>")), 1, 3), " ")
    p = F.substring("prompt", 1, T.PROMPT_CHARS)
    fields = {"context": ctx, "prompt": p}
    with_ctx = T.render(T.RESPONSE_WITH_CONTEXT, fields)
    no_ctx = T.render(T.RESPONSE_NO_CONTEXT, fields)
    return j.select("book_id", F.when(F.size(F.coalesce("lines", F.array())) > 0, with_ctx)
                    .otherwise(no_ctx).alias("text"))
