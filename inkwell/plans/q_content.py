"""Registered content-generation queries (templates rendered over every
book) and their DuckDB statements, rendered from the same fixed templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import templates as T
from inkwell.operators import content as C
from inkwell.plans.oracle import build, cte
from inkwell.plans.registry import register

AD_TYPES = ["social_media", "email", "display"]
STYLES = ["modern", "vintage", "dramatic"]
USER_TYPES = ["academic", "casual", "general"]
PROMPT_PREFIX = "Write a short promotional blurb for "


def _union(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)


def _ad_sql(table, cta_table, dashboard: bool) -> str:
    out = []
    for kv in AD_TYPES:
        cta = cta_table["social_media" if kv == "social_media" else "other"]
        for i, t in enumerate(table.get(kv, table["social_media"])):
            text = T.render_sql(t)
            if dashboard:
                out.append(f"SELECT book_id, '{kv}' AS ad_type, '#{i + 1}' AS variant, {text} AS ad_copy, "
                           f"'Template' AS type, '80%' AS confidence, CAST(length({text}) AS INTEGER) AS length, "
                           f"{T.render_sql(cta)} AS call_to_action FROM dim_books")
            else:
                out.append(f"SELECT book_id, '{kv}' AS ad_type, {i + 1} AS variant, {text} AS text, "
                           f"'template' AS type, CAST({T.AD_CONFIDENCE} AS DOUBLE) AS confidence, "
                           f"CAST(length({text}) AS INTEGER) AS length, {T.sql_literal(cta)} AS call_to_action "
                           f"FROM dim_books")
    return _union(out)


cte("ad_copy", _ad_sql(T.AD_TEMPLATES, T.AD_CALL_TO_ACTION, False), "dim_books")
register("ad_copy", build("SELECT * FROM ad_copy", "ad_copy"))(lambda m: C.ad_copy(m.dim_books, AD_TYPES))
register("ad_copy_dashboard", build(_ad_sql(T.DASHBOARD_AD_TEMPLATES, T.DASHBOARD_CALL_TO_ACTION, True),
                                    "dim_books"))(lambda m: C.ad_copy_dashboard(m.dim_books, AD_TYPES))
register("ad_copy_summary", build("""
SELECT book_id, ad_type, COUNT(*) AS variants, AVG(length) AS avg_length FROM ad_copy GROUP BY 1, 2""",
                                  "ad_copy"))(lambda m: C.ad_copy_summary(C.ad_copy(m.dim_books, AD_TYPES)))

_img = []
for _s in STYLES:
    for _i, _t in enumerate(T.IMAGE_PROMPTS[_s]):
        _x = T.render_sql(_t)
        _img.append(f"SELECT book_id, '{_s}' AS style, {_i + 1} AS n, {_x} AS prompt, "
                    f"'{T.PROMPT_FOCUS[_i % 3]}' AS focus, CAST(length({_x}) AS INTEGER) AS length FROM dim_books")
cte("image_prompts", _union(_img), "dim_books")
register("image_prompts", build("SELECT * FROM image_prompts", "image_prompts"))(
    lambda m: C.image_prompts(m.dim_books, STYLES))
register("image_prompts_dashboard", build("""
SELECT book_id, '#' || CAST(n AS VARCHAR) AS prompt_no, prompt AS image_prompt, 'Template' AS focus,
  CASE style """ + " ".join(f"WHEN '{s}' THEN '{s.title()}'" for s in STYLES) + """ END AS style, length
FROM image_prompts""", "image_prompts"))(lambda m: C.image_prompts_dashboard(m.dim_books, STYLES))

register("color_palette", build(
    "SELECT book_id, CASE lower(genre) " + " ".join(
        f"WHEN '{g}' THEN [{', '.join(T.sql_literal(c) for c in cs)}]" for g, cs in T.GENRE_COLORS.items())
    + f" ELSE [{', '.join(T.sql_literal(c) for c in T.DEFAULT_COLORS)}] END AS colors FROM dim_books",
    "dim_books"))(lambda m: C.color_palette(m.dim_books))

register("recommendation_text", build(_union([
    f"SELECT book_id, '{u}' AS user_type, "
    f"{T.render_sql(T.RECOMMENDATION_TEXT.get(u, T.RECOMMENDATION_TEXT['other']))} AS text FROM dim_books"
    for u in USER_TYPES]), "dim_books"))(lambda m: C.recommendation_text(m.dim_books, USER_TYPES))

# Brute force on purpose: every same-genre pair, numbered per book by id.
cte("same_genre_pairs", """
SELECT s.book_id, x.book_id AS other_id, x.title AS other_title, x.author AS other_author,
  row_number() OVER (PARTITION BY s.book_id ORDER BY x.book_id) AS pos
FROM dim_books s JOIN dim_books x ON x.genre = s.genre AND x.book_id <> s.book_id""", "dim_books")
register("same_genre_context", build("""
SELECT b.book_id, COALESCE(t.titles, CAST([] AS VARCHAR[])) AS titles
FROM dim_books b LEFT JOIN (
  SELECT book_id, list(other_title ORDER BY pos) AS titles FROM same_genre_pairs WHERE pos <= 3 GROUP BY book_id
) t ON b.book_id = t.book_id""", "dim_books", "same_genre_pairs"))(lambda m: C.same_genre_context(m.dim_books))

_lines = "[" + ", ".join(T.render_sql(t) for t in T.CONTEXT_LINES) + "]"
cte("book_context", f"""
SELECT b.book_id, CASE WHEN t.sim IS NULL THEN {_lines}
  ELSE list_concat({_lines}, [{T.sql_literal(T.SIMILAR_PREFIX)} || t.sim]) END AS lines
FROM (SELECT d.book_id, d.title, d.author, d.genre, d.price, p.publisher_name, p.publisher_type
      FROM dim_books d JOIN dim_publishers p ON d.publisher_id = p.publisher_id) b
LEFT JOIN (
  SELECT book_id, array_to_string(list(concat_ws(' by ', other_title, other_author) ORDER BY pos), ', ') AS sim
  FROM same_genre_pairs WHERE pos <= 3 GROUP BY book_id
) t ON b.book_id = t.book_id""", "dim_books", "dim_publishers", "same_genre_pairs")
register("book_context", build("SELECT * FROM book_context", "book_context"))(
    lambda m: C.book_context(m.dim_books, m.dim_publishers))

_with = T.render_sql(T.RESPONSE_WITH_CONTEXT, {"context": "array_to_string(lines[1:3], ' ')",
                                                "prompt": f"substring(prompt, 1, {T.PROMPT_CHARS})"})
_without = T.render_sql(T.RESPONSE_NO_CONTEXT, {"prompt": f"substring(prompt, 1, {T.PROMPT_CHARS})"})
register("context_response", build(f"""
SELECT q.book_id, CASE WHEN len(COALESCE(c.lines, [])) > 0 THEN {_with} ELSE {_without} END AS text
FROM (SELECT book_id, {T.sql_literal(PROMPT_PREFIX)} || title AS prompt FROM dim_books) q
LEFT JOIN book_context c ON q.book_id = c.book_id""", "dim_books", "book_context"))(
    lambda m: C.context_response(
        C.book_context(m.dim_books, m.dim_publishers),
        m.dim_books.select("book_id", F.concat(F.lit(PROMPT_PREFIX), F.col("title")).alias("prompt"))))
