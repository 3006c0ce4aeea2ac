"""Text folding, term search, tokens, snippets and HTML stripping (Column -> Column).

Folding has one length-preserving core (`fold_chars`): lower case, accents dropped, final
sigma made a plain sigma. Positions found in a folded text are therefore valid in the text it
was folded from, and rule terms are folded by the same rule (`fold_term`), so a term written
with a final sigma still matches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python and Unicode see it; Java's and RE2's \s are ASCII only.
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"
# The same characters for Java: three ranges rule out nearly every other character at once.
_SPACE = rf"[\x00-\x20\x{{85}}-\x{{a0}}\x{{1680}}-\x{{3000}}&&{WS}]"
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _single_base(char: str) -> str | None:
    base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
    return base if len(base) == 1 and base != char else None


def _accent_pairs(lower_only: bool) -> dict[str, str]:
    """Letter -> letter without its marks, for Latin and Greek, by decomposition."""
    pairs = {}
    for lo, hi in ((0xC0, 0x24F), (0x370, 0x3FF), (0x1E00, 0x1FFF)):
        for code in range(lo, hi + 1):
            char = chr(code)
            if lower_only and char != char.lower():
                continue
            base = _single_base(char)
            if base:
                pairs[char] = base
    return pairs


_LOWER = {**_accent_pairs(lower_only=True), "ς": "σ"}
_ANY_CASE = _accent_pairs(lower_only=False)


def _translate(c: Column, pairs: dict[str, str]) -> Column:
    mapped = F.translate(c, "".join(pairs), "".join(pairs.values()))
    # ASCII text, the common case at scale, skips the per-character lookup.
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(mapped)


def let(value: Column, body) -> Column:
    """Bind a value once for an expression that uses it many times.

    Inside array lambdas (and in the branches of a condition) Spark evaluates a repeated expression
    again each time; a lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def unnest(df, keep, array: Column, name: str = "_item", position: str | None = None):
    """One row per element of an array that is costly to compute.

    A plain explode makes Spark also test the array's size in a pushed-down filter, which computes
    it (and all it is made of) a second time; the outer form with a test on the element does not.
    """
    exploded = F.posexplode_outer(array).alias(position, name) if position else F.explode_outer(array).alias(name)
    return df.select(*keep, exploded).filter(F.col(name).isNotNull())


def clean(c: Column) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(F.regexp_replace(c, f"{_SPACE}+", " "))


def squeeze(c: Column) -> Column:
    """Drop all whitespace."""
    return F.regexp_replace(c, f"{_SPACE}+", "")


def fold_chars(c: Column) -> Column:
    """Lower, drop accents, final sigma -> sigma. Keeps the length."""
    return _translate(F.lower(c), _LOWER)


def norm_text(c: Column, underscores: bool = False) -> Column:
    """Folded text with single spaces; `underscores` also turns `_` into a space."""
    folded = fold_chars(c)
    return clean(F.translate(folded, "_", " ") if underscores else folded)


def strip_accents(c: Column) -> Column:
    """Drop combining marks, keep case."""
    return _translate(c, _ANY_CASE)


def upper_plain(c: Column) -> Column:
    """Upper case without accents, the form budget vocabulary is written in."""
    return F.upper(strip_accents(c))


def fold_term(term: str, underscores: bool = False) -> str:
    """The same folding for a rule term, done once on the driver."""
    text = "".join(_LOWER.get(ch, ch) for ch in term.lower())
    if underscores:
        text = text.replace("_", " ")
    return " ".join(text.split())


def upper_term(term: str) -> str:
    return "".join(_ANY_CASE.get(ch, ch) for ch in term).upper()


def fold_terms(terms: Iterable[str], **kw) -> list[str]:
    """Folded, non-empty, in the given order."""
    return [f for f in (fold_term(t, **kw) for t in terms) if f]


def haystack(*cols: Column, underscores: bool = False) -> Column:
    """Null-safe concatenation of columns, folded."""
    return norm_text(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), underscores)


def any_term(h: Column, terms: Sequence[str]) -> Column:
    """True if a folded text contains at least one of the folded terms."""
    test = F.lit(False)
    for term in terms:
        test = test | h.contains(term)
    return F.coalesce(test, F.lit(False))


def matched_terms(h: Column, terms: Sequence[str], labels: Sequence[str] | None = None) -> Column:
    """Array of the terms contained in a folded text, in dictionary order.

    One `contains` per term inside generated code; the folded text is computed once.
    """
    if not terms:
        return F.array().cast("array<string>")
    labels = labels or terms
    hits = [F.when(h.contains(t), F.lit(name)) for t, name in zip(terms, labels)]
    return F.array_compact(F.array(*hits))


def tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("[a-z0-9α-ω]+"), F.lit(0))


def term_tokens(term: str) -> list[str]:
    return re.findall("[a-z0-9α-ω]+", fold_term(term))


def alias_match(folded: Column, toks: Column, alias: str) -> Column:
    """A one-word alias must be a token (or, when longer than 4, a spaced word);
    a phrase must occur as its tokens joined by spaces."""
    parts = term_tokens(alias)
    if not parts:
        return F.lit(False)
    if len(parts) > 1:
        return folded.contains(" ".join(parts))
    word = parts[0]
    is_token = F.array_contains(toks, word)
    if len(word) <= 4:
        return is_token
    return is_token | F.concat(F.lit(" "), folded, F.lit(" ")).contains(f" {word} ")


def any_alias(folded: Column, toks: Column, aliases: Sequence[str]) -> Column:
    test = F.lit(False)
    for alias in aliases:
        test = test | alias_match(folded, toks, alias)
    return test


def word_bounded(folded: Column, term: str) -> Column:
    """Term not inside a longer word (letters, digits, Greek)."""
    # The plain search rules out nearly every text before the expression is tried at each of its places.
    return folded.contains(term) & folded.rlike(f"(^|[^0-9a-zα-ω]){re.escape(term)}($|[^0-9a-zα-ω])")


def focus_term(folded: Column, term: str) -> Column:
    """Place-name test: short terms and phrases need word boundaries, others are substrings."""
    plain = fold_term(term)
    if not plain:
        return F.lit(False)
    if plain.startswith("el") or (len(plain) > 3 and " " not in plain):
        return folded.contains(plain)
    return word_bounded(folded, plain)


def snippet(text: Column, pos: Column, before: int, after: Column | int, limit: int | None = None) -> Column:
    """I8: cleaned cut of `text` from `before` characters left of the 1-based `pos`
    to `after` characters right of it; `limit` caps the length."""
    start = F.greatest(pos - F.lit(before), F.lit(1))
    after = after if isinstance(after, Column) else F.lit(after)
    cut = clean(F.substr(text, start, pos + after - start))
    return F.substring(cut, 1, limit) if limit else cut


def short_sample(text: Column, limit: int, ellipsis: bool = False) -> Column:
    """Leading sample of the cleaned text, or null when empty."""
    flat = clean(text)
    cut = F.substring(flat, 1, limit)
    if ellipsis:
        cut = F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(cut), F.lit("...")))
    return F.when(F.length(flat) > 0, cut)


# Words too common in notice titles to compare.
TITLE_STOP_WORDS = [
    "και", "της", "του", "των", "στη", "στο", "στις", "στον", "για", "εργο", "εργου", "εργων",
    "δημοσ", "δημου", "διακηρυξη", "ανοιχτου", "ηλεκτρονικου", "διαγωνισμου", "δρασεισ",
]


def title_tokens(title: Column) -> Column:
    """Distinct title words of at least four characters without stop words, sorted."""
    stop = F.array(*[F.lit(fold_term(w)) for w in TITLE_STOP_WORDS])
    words = F.regexp_extract_all(norm_text(title), F.lit("[a-zα-ω0-9]{4,}"), F.lit(0))
    return F.array_sort(F.array_except(words, stop))


def token_overlap(left: Column, right: Column) -> Column:
    """Shared tokens / size of the smaller set; 0 when a side is empty."""
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller > 0, F.size(F.array_intersect(left, right)) / smaller).otherwise(F.lit(0.0))


def keyword_list(raw: Column, cap: int = 40, width: int = 80) -> Column:
    """Split on newline/comma/semicolon, clean, first of each folded form, capped."""
    items = F.split(F.coalesce(raw, F.lit("")), "[\n,;]+")

    def add(kept: Column, x: Column) -> Column:
        known = (x["key"] == "") | F.exists(kept, lambda y: y["key"] == x["key"])
        return F.when(known, kept).otherwise(F.concat(kept, F.array(x)))

    def step(kept: Column, raw_item: Column) -> Column:
        # Items after the last kept one are not cleaned; folding a cleaned item makes no blanks.
        item = let(clean(raw_item), lambda c: F.struct(fold_chars(c).alias("key"), c.alias("item")))
        return F.when(F.size(kept) >= cap, kept).otherwise(let(item, lambda x: add(kept, x)))

    kept = F.aggregate(items, F.array().cast("array<struct<key:string,item:string>>"), step)
    return F.transform(kept, lambda x: F.substring(x["item"], 1, width))


# Entities that occur in notice pages.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®",
    "middot": "·", "laquo": "«", "raquo": "»", "ndash": "–", "mdash": "—", "hellip": "…",
    "euro": "€", "bull": "•", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "deg": "°",
}


def unescape(c: Column) -> Column:
    """Character references to characters: decimal, hexadecimal and the named ones above."""
    # Most texts have none; they are not searched for each of the names.
    return let(c, lambda text: F.when(text.contains("&"), _unescape(text)).otherwise(text))


def _unescape(c: Column) -> Column:
    def numeric(piece: Column) -> Column:
        dec = F.regexp_extract(piece, r"^#(\d{1,5});", 1)
        hexa = F.regexp_extract(piece, r"^#[xX]([0-9A-Fa-f]{1,4});", 1)
        digits = F.when(dec != "", F.conv(dec, 10, 16)).when(hexa != "", hexa)
        char = F.decode(F.unhex(F.lpad(digits, 4, "0")), "UTF-16BE")
        rest = F.regexp_replace(piece, r"^#[xX]?[0-9A-Fa-f]{1,5};", "")
        return F.when(digits.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(char, rest))

    parts = F.split(c, "&(?=#)")
    refs = F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, 2, 10**9), numeric))
    out = F.when(c.contains("&#"), F.array_join(refs, "")).otherwise(c)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def strip_tags(c: Column, scripts: bool = False) -> Column:
    """Tags to spaces; `scripts` also drops script and style bodies."""
    if scripts:
        c = F.regexp_replace(c, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    return F.regexp_replace(c, "<[^>]+>", " ")


def html_text(c: Column, scripts: bool = False) -> Column:
    """Readable text of an HTML (or XML) fragment."""
    return clean(strip_tags(unescape(F.coalesce(c, F.lit(""))), scripts))


def xml_text(c: Column) -> Column:
    """Text content of an XML document: tags dropped first, then references resolved."""
    body = F.regexp_replace(c, r"(?s)<\?.*?\?>|<!--.*?-->", " ")
    return clean(unescape(strip_tags(body)))


def safe_name(c: Column, fallback: str = "document.pdf") -> Column:
    """I16: file name without reserved characters."""
    name = F.regexp_replace(clean(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_")), r"^[ .]+|[ .]+$", "")
    return F.when(F.length(name) > 0, name).otherwise(F.lit(fallback))


def url_with_params(base: Column, **params: Column) -> Column:
    """I16: url with percent-encoded query parameters; null parameters are left out."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in params.items()]
    query = F.concat_ws("&", *pairs)
    glue = F.when(F.instr(base, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return F.when(query == "", base).otherwise(F.concat(base, glue, query))


def lines(text: Column) -> Column:
    """Array of the lines of a text."""
    return F.split(text, LINE_BREAK)


def match_positions(text: Column, pattern: str) -> Column:
    """Matches with their 1-based start: array<struct<m string, pos int>>.

    The pieces between matches come from `split` with the same pattern, so the start of match
    k is the summed length of the pieces and matches before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.array().cast("array<struct<m:string,pos:int>>").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["g"])
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(pair["m"].alias("m"), at.alias("pos")))).alias("out"),
            (at + F.length(pair["m"])).alias("at"),
        )

    def placed(hits: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    return let(found, placed)
