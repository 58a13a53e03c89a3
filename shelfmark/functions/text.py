"""Text expressions: folding, searching, escaping, links, contacts and credentials."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, functions as F

from .. import constants as C
from .arrays import let, prefix_sums

_HEX2 = r"[0-9A-Fa-f]{2}"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only, so every byte offset stays valid."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def find_folded(text: Column, needle: Column) -> Column:
    """Byte offsets of the non-overlapping hits of ``needle``, both sides folded already."""
    width = F.octet_length(needle).cast("bigint")
    pieces = F.transform(
        F.split(text, F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))),
        lambda p: F.octet_length(p).cast("bigint"),
    )
    ends = let(pieces, lambda p: prefix_sums(F.slice(p, F.lit(1), F.size(p) - 1)))
    hits = F.transform(ends, lambda end, i: end + i.cast("bigint") * width)
    return F.when(width > 0, hits).otherwise(F.array().cast("array<bigint>"))


def find_all(text: Column, needle: Column) -> Column:
    """Byte offsets of the non-overlapping, ASCII-case-insensitive hits, left to right."""
    return find_folded(fold_ascii(text), fold_ascii(needle))


def collapse_ws(text: Column) -> Column:
    """Runs of space, tab, CR and LF become one space; a no-break space survives."""
    return F.regexp_replace(text, "[ \t\r\n]+", " ")


def md_escape(text: Column) -> Column:
    """Neutralise Markdown structure in a table cell."""
    escaped = F.regexp_replace(text, r"([\\|\[\]`*_!<~])", r"\\$1")
    return F.regexp_replace(escaped, r"[\r\n]", " ")


def strip_ansi(text: Column) -> Column:
    """Remove ``ESC [ .. letter`` sequences, and a lone ESC."""
    return F.regexp_replace(text, "\u001b(?:\\[[^A-Za-z]*[A-Za-z]?)?", "")


def fence_width(text: Column) -> Column:
    """One more than the longest backtick run, at least three."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)
    return F.greatest(F.coalesce(F.array_max(runs), F.lit(0)), F.lit(2)) + 1


def text_lines(text: Column) -> Column:
    """Lines without their terminators; a final line break opens no extra line."""
    parts = F.split(text, "\r?\n")
    n = F.size(parts)
    return F.when(F.get(parts, n - 1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)


def clip_lines(text: Column, limit: int = C.LINE_CLIP_CHARS) -> Column:
    """Cut lines longer than ``limit`` and mark them; text with no such line is left untouched."""
    lines = text_lines(text)
    clipped = F.transform(
        lines,
        lambda l: F.when(F.length(l) > limit, F.concat(F.substring(l, 1, limit), F.lit("…"))).otherwise(l),
    )
    too_long = F.exists(lines, lambda l: F.length(l) > limit)
    return F.when(too_long, F.array_join(clipped, "\n")).otherwise(text)


def script_profile(text: Column, chars: int | None = None) -> Column:
    """Counts per script of a text (of its first ``chars`` characters, if given)."""
    head = text if chars is None else F.substring(text, 1, chars)

    names = ("ideo", "kana", "hangul", "punct", "non_ascii", "special", "rare", "half")
    counts = {n: F.regexp_count(head, F.lit(f"[{C.SCRIPT_CLASSES[n]}]")).cast("bigint") for n in names}
    return F.struct(*[count.alias(n) for n, count in counts.items()])


def script_score(profile: Column) -> Column:
    """Score of :func:`script_profile`: 0 rejects the text, otherwise at least 1."""
    p = profile
    good = p["ideo"] + p["kana"] + p["hangul"] + p["punct"]
    other = p["non_ascii"] - good - p["special"] - p["rare"]
    bad = C.SCRIPT_SPECIAL_WEIGHT * p["special"] + C.SCRIPT_RARE_WEIGHT * p["rare"] + C.SCRIPT_OTHER_WEIGHT * other
    letters = p["ideo"] + p["kana"] + p["hangul"]

    def at_least(part: Column, of: Column, share: tuple[int, int]) -> Column:
        return part * share[1] >= of * share[0]

    dominant = (letters > 0) & (
        at_least(p["hangul"], letters, C.HANGUL_DOMINANT) | at_least(p["kana"], letters, C.KANA_DOMINANT)
    )
    score = F.greatest(good - bad + F.when(dominant, C.DOMINANT_BONUS).otherwise(0), F.lit(1))
    rejected = (p["non_ascii"] == 0) | ~at_least(good, p["non_ascii"], C.SCRIPT_KNOWN)
    return F.when(rejected, F.lit(0)).otherwise(score).cast("bigint")


def valid_email(value: Column) -> Column:
    """Structural contact rule: the shape of an address somebody could be answered at."""
    local = F.split_part(value, F.lit("@"), F.lit(1))
    domain = F.split_part(value, F.lit("@"), F.lit(2))
    host = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    return (
        F.octet_length(value).between(6, 120)
        & value.rlike(r"^[!#$%&'*+\-.0-9=?@A-Z^_`a-z|~]+\z")
        & (F.regexp_count(value, F.lit("@")) == 1)
        & F.length(local).between(1, 64)
        & (domain != "")
        & ~domain.rlike("^-|-$")
        & domain.rlike(r"\.[A-Za-z]{2,}$")
        & (host != "")
        & ~host.rlike(r"^\.|\.$|\.\.")
    )


def secret_kind(value: Column) -> Column:
    """First credential shape a whole value matches; NULL for none."""
    token = _trim(value)
    out = None
    for name, pattern in C.SECRET_PATTERNS:
        out = F.when(token.rlike(pattern), name) if out is None else out.when(token.rlike(pattern), name)
    block = F.contains(token, F.lit("-----BEGIN ")) & F.contains(token, F.lit("PRIVATE KEY-----"))
    return out.when(block, "private_key")


# --- file names ---------------------------------------------------------------------------

_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def safe_component(text: Column) -> Column:
    """A name every desktop file system accepts; ``image`` when nothing usable is left."""
    def named(cleaned: Column) -> Column:
        stem = F.upper(F.substring_index(cleaned, ".", 1))
        return F.when((cleaned == "") | stem.isin(*C.RESERVED_NAMES), "image").otherwise(cleaned)

    dashed = F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1F]', "-")
    return let(_trim(F.regexp_replace(_trim(dashed), r"[. ]+$", "")), named)


def expand_template(
    template: str, *, artist: Column, album: Column, title: Column, track: Column, missing: str
) -> Column:
    """One left-to-right pass over the template; a value that contains a token is not expanded."""
    values = {
        "$artist": artist,
        "$album": album,
        "$title": title,
        "$track": F.when(track.isNotNull(), F.format_string("%02d", track)),
    }
    pieces = re.split(r"(\$artist|\$album|\$title|\$track)", template)
    return F.concat(
        *[F.coalesce(values[p], F.lit(missing)) if p in values else F.lit(p) for p in pieces]
    )


def template_path(expanded: Column) -> Column:
    """Nested folder from an expanded template; NULL when no usable part remains."""
    parts = F.filter(
        F.transform(F.split(expanded, r"[/\\]"), _trim), lambda p: p != ""
    )
    return let(parts, lambda p: F.when(F.size(p) > 0, F.array_join(F.transform(p, safe_component), "/")))


def rename_base(
    pattern: str,
    *,
    taken: Column | None = None,
    camera: Column | None = None,
    artist: Column | None = None,
    title: Column | None = None,
    track: Column | None = None,
) -> Column:
    """New base name under a rename pattern; NULL when its anchor (date or title) is missing."""
    if pattern == "date_taken":
        return taken
    if pattern == "camera_date":
        return F.when(taken.isNotNull(), F.concat_ws(" ", safe_component(camera), taken))
    if pattern == "artist_title":
        return F.when(title.isNotNull(), F.concat_ws(" - ", artist, title))
    if pattern == "track_title":
        number = F.when(track.isNotNull(), F.format_string("%02d", track))
        return F.when(title.isNotNull(), F.concat_ws(" - ", number, title))
    raise ValueError(f"unknown rename pattern: {pattern}")


# --- links --------------------------------------------------------------------------------

_URL_CHARS = r"A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%"
_TAIL_CHARS = r".,;:!?'\"*_~"
# A bare address: opener or start before it, then a scheme and a dot that some kept character follows.
_BARE_URL = (
    r"(?<![^ \t\n\r(\[{<*_~\"'])"
    r"((?i:https?://|www\.)"
    rf"(?=[{_URL_CHARS}]*\.[{_TAIL_CHARS})]*[{_URL_CHARS}&&[^{_TAIL_CHARS})]]"
    rf"|[{_URL_CHARS}]*\([{_URL_CHARS}]*\.[{_TAIL_CHARS}]*\))"
    rf"[{_URL_CHARS}]+)"
)


def _trim_url(raw: Column) -> Column:
    """Drop trailing punctuation; a closing bracket stays only while it balances an opening one."""
    tail = F.regexp_extract(raw, rf"([{_TAIL_CHARS})]*)$", 1)
    body = F.substring(raw, F.lit(1), F.length(raw) - F.length(tail))
    open_left = F.regexp_count(body, F.lit(r"\(")) - F.regexp_count(body, F.lit(r"\)"))
    keep = F.greatest(F.least(F.regexp_count(tail, F.lit(r"\)")), open_left), F.lit(0))
    parts = F.split(tail, r"\)")
    kept = F.when(
        keep > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), keep), ")"), F.lit(")"))
    ).otherwise("")
    return F.concat(body, kept)


def linkify(text: Column) -> Column:
    """Bare web addresses of a text in order, as an array of (text, href)."""
    raw = F.regexp_extract_all(text, F.lit(_BARE_URL), F.lit(1))
    urls = F.filter(
        F.transform(raw, _trim_url),
        lambda u: F.contains(F.regexp_replace(u, r"^(?i:https?://|www\.)", ""), F.lit(".")),
    )
    return F.transform(
        urls,
        lambda u: F.struct(
            u.alias("text"),
            F.when(u.rlike("^(?i:www)"), F.concat(F.lit("https://"), u)).otherwise(u).alias("href"),
        ),
    )


def percent_decode(text: Column) -> Column:
    """``%XX`` to bytes, read as UTF-8; malformed escapes and ``+`` stay as they are."""
    guarded = F.replace(
        F.regexp_replace(text, f"%(?!{_HEX2})", "%25"), F.lit("+"), F.lit("%2B")
    )
    return F.when(F.contains(text, F.lit("%")), F.url_decode(guarded)).otherwise(text)


def is_remote(src: Column) -> Column:
    return src.rlike(r"(?i)^\s*https?://")


def resolve_src(src: Column, base: Column) -> Column:
    """Local image source against the document folder; NULL for an empty one."""
    bare = F.regexp_extract(src, r"^([^?#]*)", 1)
    local = F.regexp_replace(percent_decode(bare), r"^\./", "")
    absolute = local.rlike(r"^(?:[A-Za-z]:)?[/\\]")
    return F.when(bare != "", F.when(absolute, local).otherwise(F.concat(base, F.lit("/"), local)))


# --- entities -----------------------------------------------------------------------------

_ENTITY_TOKEN = r"(&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[a-z]+);|[^&]+|&)"


def _entity(token: Column) -> Column:
    digits = F.regexp_extract(token, r"^&#([0-9]+);$", 1).try_cast("bigint")
    hexa = F.conv(F.nullif(F.regexp_extract(token, r"^&#[xX]([0-9A-Fa-f]+);$", 1), F.lit("")), 16, 10)
    code = F.coalesce(digits, hexa.try_cast("bigint"))
    valid = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
    out = F.when(~token.startswith("&") | (F.length(token) < 4), token)
    for name, value in C.ENTITIES.items():
        out = out.when(token == f"&{name};", value)
    return out.when(valid, char).otherwise(token)


def decode_entities(text: Column) -> Column:
    """Named and numeric entities in one pass: what a decoded entity spells is not decoded again."""
    def decoded(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(_ENTITY_TOKEN), F.lit(1))
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(tokens, _entity), "")).otherwise(t)

    return let(text, decoded)


def clip_text(text: Column, limit: int) -> Column:
    """First ``limit`` characters, marked with an ellipsis when cut."""
    cut = F.concat(F.substring(text, 1, limit), F.lit("…"))
    return F.when(F.length(text) > limit, cut).otherwise(text)
