"""URL, text and date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL pattern (scheme, host part, path).
URL_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def _trim_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^\s+|\s+$", "")


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme, host part and path as written; missing parts are ''."""
    clean = _trim_url(url)
    return tuple(F.regexp_extract(clean, URL_PATTERN, i) for i in (1, 2, 3))


def build_url(scheme: Column, host: Column, path: Column) -> Column:
    """Canonical form: lower-case scheme and host, no trailing '/', parameters, query or fragment."""
    bare = F.regexp_replace(F.regexp_replace(path, ";[^/]*$", ""), "/+$", "")
    rooted = F.when(bare == "", "/").when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    named = F.when(scheme == "", "https").otherwise(F.lower(scheme))
    return F.concat(named, F.lit("://"), F.lower(host), rooted)


def normalize_url(url: Column) -> Column:
    return build_url(*url_parts(url))


def _resolve_dots(path: Column) -> Column:
    """Apply '.' and '..' segments of an absolute path."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.array_append(acc, s)))
    return F.array_join(kept, "/")


def absolutize_url(base: Column, href: Column) -> Column:
    """Resolve a link against the page it is on, then normalise it."""
    base_scheme, base_host, base_path = url_parts(base)
    scheme, host, path = url_parts(href)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    joined = (
        F.when(path == "", base_path).when(path.startswith("/"), path)
        .otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path)))
    relative = build_url(base_scheme, base_host, _resolve_dots(joined))
    same_scheme = build_url(base_scheme, host, path)
    return F.when(scheme != "", build_url(scheme, host, path)).when(host != "", same_scheme).otherwise(relative)


def casefold(text: Column) -> Column:
    """Lower case plus the common letters whose case folding differs from it."""
    folded = F.lower(text)
    for letter, other in (("ſ", "s"), ("ς", "σ"), ("ß", "ss")):
        folded = F.replace(folded, F.lit(letter), F.lit(other))
    return folded


def normalize_text(text: Column) -> Column:
    """One space between words, trimmed, case folded; NULL becomes ''."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return casefold(F.trim(spaced))


def clean_text(text: Column) -> Column:
    """Collapse blanks, keep at most one empty line, strip lines; empty becomes NULL."""
    blanks = F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"[ \t\r\f\x0B]+", " ")
    lines = F.regexp_replace(blanks, r"\n{3,}", "\n\n")
    stripped = F.regexp_replace(lines, r"(?m)^ +| +$", "")
    return F.nullif(F.regexp_replace(stripped, r"^\s+|\s+$", ""), F.lit(""))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_url(url: Column) -> Column:
    return sha(normalize_url(url))


def hash_content(text: Column) -> Column:
    return sha(normalize_text(text))


def join_parts(*parts: Column) -> Column:
    """Non-empty parts joined by a space."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def semantic_hash(title: Column, summary: Column, content: Column, limit: int | None = None) -> Column:
    """Hash of the whole article, or of its first ``limit`` characters."""
    joined = join_parts(title, summary, content)
    return hash_content(F.substring(joined, 1, limit) if limit else joined)


def embedding_text(title: Column, summary: Column, content: Column, limit: int | None = None) -> Column:
    """Text given to an embedding model; ``limit`` is the input size of models that have one."""
    joined = normalize_text(join_parts(title, summary, content))
    return F.substring(joined, 1, limit) if limit else joined


# Accepted date layouts, ISO first, then mail style.
DATE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
)
MAIL_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm")


def parse_datetime(text: Column) -> Column:
    """ISO or mail-style date to a UTC timestamp (zone-less text is UTC); NULL if unreadable."""
    raw = F.trim(text)
    mail = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT)$", "+0000")
    tries = [F.try_to_timestamp(raw, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries, *[F.try_to_timestamp(mail, F.lit(f)) for f in MAIL_FORMATS])


# Path parts of pages that are no articles.
NO_ARTICLE = "/video|/videos|/photos|/live-tv|/podcast|/author/"


def is_article_url(url: Column) -> Column:
    scheme, _, path = url_parts(url)
    lowered = F.lower(path)
    wanted = lowered.contains("/news/") | lowered.endswith(".html") | lowered.rlike("[0-9]")
    return F.lower(scheme).startswith("http") & ~lowered.rlike(NO_ARTICLE) & wanted


# Phrases of links that are no headlines.
NO_HEADLINE = "subscribe|download app|follow us|sign in|watch live"


def is_headline_link(href: Column, title: Column) -> Column:
    path = F.lower(url_parts(href)[2])
    wanted = path.contains("/news/") | path.contains("/market/") | path.endswith(".html")
    return F.length(title).between(35, 220) & ~F.lower(title).rlike(NO_HEADLINE) & wanted


# Display names by host.
SOURCE_NAMES = (("moneycontrol", "Moneycontrol"), ("cnbctv18", "CNBC TV18"))


def source_name(url: Column) -> Column:
    host = F.lower(url_parts(url)[1])
    chain = F
    for token, name in SOURCE_NAMES:
        chain = chain.when(host.contains(token), name)
    return chain.when(host != "", host).otherwise("live-news")


def language_tag(source: Column, declared: Column) -> Column:
    """Declared language, 'en' by default; one source publishes in Hindi only."""
    return F.when(source == "cnbcawaaz", "hi").otherwise(F.coalesce(F.nullif(declared, F.lit("")), F.lit("en")))


def distinct_tags(tags: Column, limit: int | None = None) -> Column:
    """Cleaned tags in first-seen order, the first ``limit`` of them if one is given."""
    found = F.array_distinct(F.filter(F.transform(tags, clean_text), lambda t: t.isNotNull()))
    return F.slice(found, 1, limit) if limit else found


def feature_version(name: Column, signature: Column, year: Column) -> Column:
    digest = F.substring(sha(F.concat(name, F.lit(":"), signature)), 1, 8)
    return F.concat(F.lit("v"), year.cast("string"), F.lit("."), digest)
