"""Text, URL and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a blocked download in a job's message.
BLOCK_SIGNS = ("HTTP 403", "HTTP 429", "HTTP 503", "Access Denied", "Cloudflare", "Captcha", "Forbidden", "Too Many Requests", "Blocked")
#: What marks a page that a firewall has put in place of the one asked for.
FIREWALL_SIGNS = ("cloudflare", "access denied", "403 forbidden", "captcha")
#: Extensions of files that are not pages.
BINARY_EXTENSIONS = ("pdf", "jpg", "png", "gif", "mp4", "zip", "exe")


def url_hash(url: Column) -> Column:
    """MD5 of the URL without its query."""
    return F.md5(F.split_part(url, F.lit("?"), F.lit(1)))


def url_date(url: Column) -> Column:
    """The date in /YYYY/M/D or /YYYY-M-D, null where there is none or it is no date."""
    pattern = r"/(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?!\d)"
    part = lambda i: F.regexp_extract(url, pattern, i)
    iso = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(url.rlike(pattern), F.try_to_date(iso, "yyyy-MM-dd"))


def capitalised(text: Column) -> Column:
    """First character upper case, all others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def last_unique_words(words: Column, n: int = 100) -> Column:
    """The last n distinct words, each at its newest place, order kept."""
    return F.reverse(F.slice(F.array_distinct(F.reverse(words)), 1, n))


def search_query(title: Column, topics: Column, entities: Column) -> Column:
    """Title, topics and the first five entities in one line."""
    return F.concat_ws(" ", title, F.array_join(topics, " "), F.array_join(F.slice(entities, 1, 5), " "))


def head_and_tail(text: Column, limit: int, marker: str = "\n...\n") -> Column:
    """Texts over the limit keep the first 70 % and the last 30 % of it around a marker."""
    head, tail = int(limit * 0.7), limit - int(limit * 0.7)
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail)))).otherwise(text)


def cut_at_stop_line(text: Column, phrases: list[str], short: int = 150) -> Column:
    """Text before the first line under ``short`` characters that holds a stop phrase (any case).

    If under 50 characters are left of more than 200, the first 2000 characters of the whole text.
    """
    lines = F.split(text, "\n", -1)
    stops = F.transform(lines, lambda x: (F.char_length(F.trim(x)) < short) & F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(F.lower(x), p)))
    at = F.array_position(stops, F.lit(True))
    cut = F.trim(F.when(at > 0, F.array_join(F.slice(lines, 1, (at - 1).cast("int")), "\n")).otherwise(text))
    return F.when((F.char_length(cut) < 50) & (F.char_length(text) > 200), F.substring(text, 1, 2000)).otherwise(cut)


def looks_blocked(message: Column, signs: tuple[str, ...] = BLOCK_SIGNS) -> Column:
    """whether the message holds one of the signs, in any case; null holds none."""
    return F.coalesce(message.rlike("(?i)" + "|".join(signs)), F.lit(False))


def is_firewall_page(html: Column, head: int = 1000, signs: tuple[str, ...] = FIREWALL_SIGNS) -> Column:
    """whether the first characters of a page hold one of the signs, in any case; null and empty pages don't."""
    return F.coalesce(F.substring(html, 1, head).rlike("(?i)" + "|".join(signs)), F.lit(False))


def is_binary_url(url: Column, extensions: tuple[str, ...] = BINARY_EXTENSIONS) -> Column:
    """whether the URL, its query aside, ends in one of the extensions, in any case."""
    return F.lower(F.split_part(url, F.lit("?"), F.lit(1))).rlike(r"\.(" + "|".join(extensions) + ")$")


def lock_key(title: Column) -> Column:
    """CRC32 of a title, which tells apart what may be worked on at once; null counts as empty."""
    return F.crc32(F.coalesce(title, F.lit("")).cast("binary"))


def prefix(text: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(text, 1, n)


def embedding_input(text: Column, phrases: list[str], limit: int = 20_000, label: str = "search_document: ") -> Column:
    """What is handed to an encoder: cut at its stop lines, then at ``limit`` characters, with the label in front.

    Null for texts of fewer than 10 characters: their vector is zero.
    """
    return F.when(F.char_length(text) >= 10, F.concat(F.lit(label), F.substring(cut_at_stop_line(text, phrases), 1, limit)))


def repaired_json(reply: Column) -> Column:
    """A model's reply without thought blocks and fences, from its first bracket to its last; null if that isn't JSON."""
    plain = F.regexp_replace(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    body = F.regexp_extract(plain, r"(?s)([\[{].*[\]}])", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def wrapped_json(reply: Column, field: str) -> Column:
    """A repaired reply where an object with a list ``field`` is wanted: a bare list, or one item of it, is wrapped."""
    body = F.trim(repaired_json(reply))
    is_list, has_field = body.startswith("["), F.get_json_object(body, f"$.{field}").isNotNull()
    return F.when(is_list, F.concat(F.lit(f'{{"{field}":'), body, F.lit("}"))).when(has_field, body).otherwise(F.concat(F.lit(f'{{"{field}":['), body, F.lit("]}")))
