"""Publication dates of pages: from JSON-LD, the URL and a time near it, head metadata, or the text (2.9).

All are column expressions over HTML or text; what needs a date-guessing library is left to the caller as ``fallback``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import url_date

#: Kinds of JSON-LD objects that carry a publication date.
ARTICLE_TYPES = ("NewsArticle", "Article", "BlogPosting", "Report")
#: Head metadata with a publication date, in order of trust.
DATE_META = (("property", "article:published_time"), ("property", "og:published_time"), ("name", "pubdate"), ("name", "sailthru.date"))
#: Words before a date in the text.
DATE_WORDS = ("publicado", "atualizado", "data")
_HIDDEN = "script|style|nav|footer|header|iframe|svg"
_FORMATS = ("yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][.SSS][XXX][X]", "yyyy-MM-dd[ HH:mm[:ss]][XXX]", "d/M/yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]", "d MMM yyyy HH:mm[:ss][ Z]")


def parsed_date(text: Column, as_of: Column | None = None) -> Column:
    """A time from any common form, the day before the month; without a zone it is UTC. Null if none fits.

    With ``as_of``, later times are null as well.
    """
    # Names of days say nothing new, and GMT is a zone of its own in no form.
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9}, *", ""), r"(?:GMT|UTC)$", "+0000")
    found = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in _FORMATS])
    return found if as_of is None else F.when(found <= as_of.cast("timestamp"), found)


def loose_date(text: Column) -> Column:
    """The first yyyy-mm-dd or yyyy/mm/dd anywhere in a text."""
    return F.try_to_date(F.replace(F.regexp_extract(text, r"\d{4}[-/]\d{2}[-/]\d{2}", 0), F.lit("/"), F.lit("-")), "yyyy-MM-dd")


def visible_text(html: Column) -> Column:
    """The text of a page without scripts, styles and page furniture, white space runs as one space."""
    bare = F.regexp_replace(F.regexp_replace(html, rf"(?is)<({_HIDDEN})\b[^>]*>.*?</\1\s*>", " "), r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def date_tags(html: Column) -> Column:
    """The tags that may carry a date: time elements, metadata, and elements whose class or id speaks of one."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<(?:time\b[^>]*>.*?</time|meta\b[^>]*(?:date|time|publi)[^>]*|(?:span|div|p|small)\b[^>]*(?:class|id)\s*=\s*[\"'][^\"']*(?:date|time|publi|header|info)[^>]*>[^<]*)"), F.lit(0))


def json_ld_date(html: Column) -> Column:
    """The date of the first article object of the page's JSON-LD blocks, @graph members and lists included."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    wanted = "|".join(ARTICLE_TYPES)

    def objects(block: Column) -> Column:
        many = lambda x: F.from_json(x, "array<string>")
        b = F.trim(block)
        return F.coalesce(F.when(b.startswith("["), many(b)), many(F.get_json_object(b, "$['@graph']")), F.array(b))

    def date(o: Column) -> Column:
        kind = F.get_json_object(o, "$['@type']")
        is_article = kind.rlike(rf'^(?:{wanted})$') | kind.rlike(rf'"(?:{wanted})"')
        return F.when(is_article, F.coalesce(F.get_json_object(o, "$.datePublished"), F.get_json_object(o, "$.dateCreated")))

    found = F.array_compact(F.transform(F.flatten(F.transform(blocks, objects)), date))
    return parsed_date(F.get(found, F.lit(0)))


def time_near(date: Column, text: Column) -> Column:
    """The date at the first HH:MM or HHhMM at most 50 characters behind it in the text; midnight without one."""
    day = F.date_format(date, "dd")
    forms = (F.concat(day, F.lit("[/.]"), F.date_format(date, "MM")), F.date_format(date, "yyyy-MM-dd"))
    clock = F.lit(r".{0,50}?(\d{1,2}[:h]\d{2})")
    raw = F.coalesce(*[F.nullif(F.call_function("regexp_extract", text, F.concat(f, clock), F.lit(1)), F.lit("")) for f in forms])
    at = F.lpad(F.replace(raw, F.lit("h"), F.lit(":")), 5, "0")
    return F.coalesce(F.try_to_timestamp(F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), at), F.lit("yyyy-MM-dd HH:mm")), date.cast("timestamp"))


def meta_date(html: Column) -> Column:
    """The first date of the head's metadata."""
    head = F.regexp_extract(html, r"(?is)<head\b[^>]*>(.*?)</head\s*>", 1)
    tags = F.regexp_extract_all(head, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def one(attr: str, name: str) -> Column:
        own = F.get(F.filter(tags, lambda t: t.rlike(rf"(?i){attr}\s*=\s*[\"']{name}[\"']")), F.lit(0))
        return parsed_date(F.regexp_extract(own, r"(?is)content\s*=\s*[\"']([^\"']*)[\"']", 1))

    return F.coalesce(*[one(a, n) for a, n in DATE_META])


def spoken_date(text: Column) -> Column:
    """The date that follows "publicado", "atualizado" or "data"; null if the first such date is none."""
    found = F.regexp_extract(text, rf"(?is)(?:{'|'.join(DATE_WORDS)}).*?(\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{4}}(?:\s+\d{{1,2}}[:h]\d{{2}})?)", 1)
    return parsed_date(F.replace(F.regexp_replace(found, r"\s+", " "), F.lit("h"), F.lit(":")))


def published_date(url: Column, html: Column, fallback: Column | None = None) -> Column:
    """The first date found: JSON-LD, the URL's with a time near it in the text, head metadata, the text, fallback."""
    text = visible_text(html)
    from_url = url_date(url)
    ladder = [json_ld_date(html), F.when(from_url.isNotNull(), time_near(from_url, text)), meta_date(html), spoken_date(text)]
    return F.coalesce(*ladder, *([fallback] if fallback is not None else []))
