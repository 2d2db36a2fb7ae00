"""Text templates of the content generators and their rendering.

A template is plain text with ``{field}`` placeholders; ``render`` turns it
into a JVM-side ``concat_ws`` of literals and columns (no Python UDF),
and ``render_sql`` into the same concatenation for the SQL oracle.
Fields: title, author, genre, genre_lower, price (two decimals), user_type.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (wording must equal the source generators exactly).
# ---------------------------------------------------------------------------
AD_TEMPLATES = {
    "social_media": [
        "📚 Discover {title} by {author} - A captivating {genre_lower} story! ✨ #BookLovers #Reading",
        "🔥 New read alert! {title} will take you on an unforgettable journey. Get your copy today! 📖",
        "⭐ Why readers love {title}: Engaging plot, brilliant writing, {genre} at its best! 🎯",
    ],
    "email": [
        "Subject: Don't Miss Out - {title} Now Available\n\nDear Reader,\n\nExperience the compelling world of {title} by {author}. This {genre_lower} masterpiece is priced at just ${price}.",
        "Subject: Your Next Great Read Awaits\n\n{title} by {author} has arrived! Join thousands of readers discovering this {genre_lower} gem.",
    ],
    "display": [
        "{title} - The {genre} Novel Everyone's Talking About",
        "From acclaimed author {author} comes {title} - Available Now",
    ],
}
DASHBOARD_AD_TEMPLATES = {
    "social_media": [
        "📚 Discover {title} by {author} - A captivating {genre_lower} story! ✨ #BookLovers #ReadingCommunity",
        "🔥 New read alert! {title} will take you on an unforgettable journey. Get your copy today! 📖",
        "⭐ Why readers love {title}: Engaging plot, brilliant writing, {genre} at its best! 🎯",
    ],
    "email": [
        "Subject: Don't Miss Out - {title} Now Available\n\nDear Reader, Experience the compelling world of {title} by {author}. This {genre_lower} masterpiece is priced at just ${price}.",
        "Subject: Your Next Great Read Awaits\n\n{title} by {author} has arrived! Join thousands of readers who've already discovered this {genre_lower} gem.",
    ],
    "display": [
        "{title} - The {genre} Novel Everyone's Talking About",
        "From acclaimed author {author} comes {title} - Available Now",
    ],
}
AD_CALL_TO_ACTION = {"social_media": "Order now!", "other": "Learn more"}
DASHBOARD_CALL_TO_ACTION = {"social_media": "Order ${genre} now!", "other": "Learn More"}
# Values that requests may name; those without texts of their own use the first entry's.
AD_TYPES = ["social_media", "email", "display", "print"]
AD_CONFIDENCE = 0.8

IMAGE_PROMPTS = {
    "modern": [
        "Modern book cover design for '{title}' by {author} - clean, minimalist {genre_lower} style",
        "Contemporary book cover featuring themes from '{title}' - sleek typography and modern aesthetics",
        "Minimalist cover design for {genre} book '{title}' - professional and eye-catching",
    ],
    "vintage": [
        "Vintage-style book cover for '{title}' - classic {genre_lower} design with retro typography",
        "Retro book cover design for '{title}' by {author} - nostalgic and timeless",
        "Classic vintage cover for {genre} novel '{title}' - elegant and traditional",
    ],
    "dramatic": [
        "Dramatic book cover for '{title}' - bold {genre_lower} imagery with striking visuals",
        "High-impact cover design for '{title}' by {author} - compelling and intense",
        "Bold dramatic cover for {genre} book '{title}' - attention-grabbing design",
    ],
}
PROMPT_FOCUS = ["cover", "typography", "theme"]
IMAGE_STYLES = ["modern", "vintage", "minimalist", "dramatic", "artistic", "commercial"]

GENRE_COLORS = {
    "fiction": ["navy", "gold", "cream"],
    "fantasy": ["purple", "silver", "dark blue"],
    "science": ["blue", "white", "gray"],
    "biography": ["brown", "beige", "dark green"],
    "romance": ["pink", "gold", "white"],
    "mystery": ["black", "red", "gray"],
    "thriller": ["red", "black", "white"],
}
DEFAULT_COLORS = ["blue", "white", "gray"]

RECOMMENDATION_TEXT = {
    "academic": "For academic readers: {title} by {author} offers deep insights into {genre_lower} themes with scholarly rigor.",
    "casual": "Perfect for your next read: {title} is an engaging {genre_lower} book that's hard to put down!",
    "other": "Highly recommended: {title} by {author} - a compelling {genre_lower} work that readers are loving.",
}

CONTEXT_LINES = [
    "Title: {title}",
    "Author: {author}",
    "Genre: {genre}",
    "Publisher: {publisher_name} ({publisher_type})",
    "Price: ${price}",
]
SIMILAR_PREFIX = "Similar books: "
RESPONSE_WITH_CONTEXT = "Based on {context}, here's a response to: {prompt}..."
RESPONSE_NO_CONTEXT = "Generated response for: {prompt}..."
PROMPT_CHARS = 50
# ---------------------------------------------------------------------------

_FIELD = re.compile(r"\{(\w+)\}")


def field_columns() -> dict[str, Column]:
    """Placeholder -> column over a frame with title, author, genre, price
    (price printed with two decimals from its DECIMAL value)."""
    return {
        "title": F.col("title"), "author": F.col("author"), "genre": F.col("genre"),
        "genre_lower": F.lower(F.col("genre")),
        "price": F.col("price").cast("decimal(12,2)").cast("string"),
        "publisher_name": F.col("publisher_name"), "publisher_type": F.col("publisher_type"),
        "user_type": F.col("user_type"), "context": F.col("context"), "prompt": F.col("prompt"),
    }


def _pieces(template: str):
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            yield ("text", template[pos:m.start()])
        yield ("field", m.group(1))
        pos = m.end()
    if pos < len(template):
        yield ("text", template[pos:])


def render(template: str, fields: dict[str, Column] | None = None) -> Column:
    fields = fields or field_columns()
    parts = [F.lit(v) if kind == "text" else fields[v] for kind, v in _pieces(template)]
    return F.concat_ws("", *parts)


SQL_FIELDS = {
    "title": "title", "author": "author", "genre": "genre", "genre_lower": "lower(genre)",
    "price": "CAST(CAST(price AS DECIMAL(12,2)) AS VARCHAR)", "publisher_name": "publisher_name",
    "publisher_type": "publisher_type", "user_type": "user_type", "context": "context", "prompt": "prompt",
}


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def render_sql(template: str, fields: dict[str, str] | None = None) -> str:
    fields = fields or SQL_FIELDS
    parts = [sql_literal(v) if kind == "text" else fields[v] for kind, v in _pieces(template)]
    return "concat_ws('', " + ", ".join(parts) + ")"
