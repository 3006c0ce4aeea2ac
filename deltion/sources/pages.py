"""HTML and text pages: listings, grids, labelled fields, attachments, change tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltion.functions.dates import listing_dates
from deltion.functions.extract import first_system_id
from deltion.functions.text import clean, match_positions, strip_tags, unescape, unnest
from deltion.operators.filters import is_document_url, is_landing
from deltion.operators.ranking import first_wins

ANCHOR = """(?is)<a\\b[^>]*?href=["']([^"']+)["'][^>]*>(.*?)</a>"""


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of a link on a page."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(https?://[^/]+(?:/.*)?/)", 1)
    folder = F.when(folder.rlike("^https?://[^/]+/"), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))
    )


def page_links(pages: DataFrame, html: str, url: str, keep: Sequence[str]) -> DataFrame:
    """A4: anchors of pages in order: text, absolute address, whether it is a document."""
    found = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(0))
    flat = unnest(pages, [*keep, url], found, "_a", "position")
    target = resolve(F.col(url), unescape(F.regexp_extract("_a", ANCHOR, 1)))
    text = clean(unescape(strip_tags(F.regexp_extract("_a", ANCHOR, 2))))
    return flat.select(*keep, "position", text.alias("title"), target.alias("link_url")).withColumn("is_document", is_document_url(F.col("link_url")))


def table_listing(pages: DataFrame, html: str, url: str, keep: Sequence[str], row_tag: str = "tr") -> DataFrame:
    """A4: flat listings: one item per row element with title, page, documents, date and text.

    Works on row elements that do not nest (`tr`, `li`); landing rows are left out.
    """
    rows = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<{row_tag}\b[^>]*>(.*?)</{row_tag}>"), F.lit(1))
    flat = unnest(pages, [*keep, url], rows, "_row", "position")
    links = F.regexp_extract_all("_row", F.lit(ANCHOR), F.lit(0))
    pairs = F.transform(links, lambda a: F.struct(
        resolve(F.col(url), unescape(F.regexp_extract(a, ANCHOR, 1))).alias("href"), clean(unescape(strip_tags(F.regexp_extract(a, ANCHOR, 2)))).alias("text")
    ))
    docs = F.filter(pairs, lambda p: is_document_url(p["href"]))
    others = F.filter(pairs, lambda p: ~is_document_url(p["href"]))
    titled = F.filter(pairs, lambda p: p["text"] != "")
    items = flat.select(
        *keep, "position", F.try_element_at(titled, F.lit(1))["text"].alias("title"), F.try_element_at(others, F.lit(1))["href"].alias("detail_url"),
        F.transform(docs, lambda p: p["href"]).alias("attachment_urls"), F.nullif(F.regexp_extract("_row", r'(?i)<time\b[^>]*datetime="([^"]+)"', 1), F.lit("")).alias("published_at"),
        clean(unescape(strip_tags(F.col("_row")))).alias("row_text"),
    )
    some = F.col("title").isNotNull() | F.col("detail_url").isNotNull() | (F.size("attachment_urls") > 0)
    return items.filter(some & ~is_landing(F.col("title"), F.col("detail_url")))


# Elements and classes that hold an item of a listing, and elements that never have an end.
CONTAINER_TAGS = ("article", "li")
CONTAINER_HINTS = ("views-row", "premium-blog-post", "post", "article", "blog")
VOID_TAGS = ("br", "img", "input", "meta", "link", "hr")

#: A comment, a script or style with its text, or a tag; the parts of a page that text stands between.
MARKUP = r"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|<!?/?[a-z][^>]*>"
TAG_NAME, TAG_CLASS = r"(?is)^</?([a-z][a-z0-9-]*)", r"""(?is)\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def container_spans(html: Column) -> Column:
    """Outermost listing containers of a page with what nests in them: array<struct<first, last>>, 1-based places of characters.

    A stack of open containers is folded over the tags of the page: a start tag that holds an item is put on it, an end tag
    takes the top off if it has the same name, and a container ends where the stack gets empty. One left open is no item.
    """
    def event(hit: Column) -> Column:
        tag = hit["m"]
        name = F.lower(F.regexp_extract(tag, TAG_NAME, 1))
        styles = F.concat(F.regexp_extract(tag, TAG_CLASS, 1), F.regexp_extract(tag, TAG_CLASS, 2), F.regexp_extract(tag, TAG_CLASS, 3))
        holds = name.isin(*CONTAINER_TAGS) | (styles.rlike("|".join(CONTAINER_HINTS)) & ~name.isin(*VOID_TAGS))
        opens = ~tag.startswith("</") & holds & (name != "")
        return F.struct(name.alias("name"), opens.alias("opens"), tag.startswith("</").alias("ends"), hit["pos"].cast("int").alias("first"), (hit["pos"] + F.length(tag) - 1).cast("int").alias("last"))

    def step(acc: Column, e: Column) -> Column:
        depth = F.size(acc["open"])
        closes = e["ends"] & (depth > 0) & F.coalesce(F.try_element_at(acc["open"], F.lit(-1)) == e["name"], F.lit(False))
        return F.struct(
            F.when(e["opens"], F.array_append(acc["open"], e["name"])).when(closes, F.slice(acc["open"], F.lit(1), depth - 1)).otherwise(acc["open"]).alias("open"),
            F.when(e["opens"] & (depth == 0), e["first"]).otherwise(acc["first"]).alias("first"),
            F.when(closes & (depth == 1), F.array_append(acc["spans"], F.struct(acc["first"].alias("first"), e["last"].alias("last")))).otherwise(acc["spans"]).alias("spans"),
        )

    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("first"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))
    events = F.filter(F.transform(match_positions(html, MARKUP), event), lambda e: e["opens"] | e["ends"])
    return F.aggregate(events, start, step, lambda acc: acc["spans"])


def extract_html_listing(pages: DataFrame, html: str, url: str, keep: Sequence[str]) -> DataFrame:
    """A4: items of article or post listings whose containers nest: first link that is no document, documents, last time, text.

    All in columns, inside the row of a page until its items are known; a page without containers gives none.
    """
    spans = unnest(pages, [*keep, url, html], container_spans(F.col(html)), "_s", "position")
    part = spans.select(*keep, url, "position", F.substr(F.col(html), F.col("_s.first"), F.col("_s.last") - F.col("_s.first") + 1).alias("_part"))
    part = part.withColumn("_part", F.regexp_replace("_part", r"(?is)<!--.*?-->", ""))
    links = F.transform(F.regexp_extract_all("_part", F.lit(ANCHOR), F.lit(0)), lambda a: F.struct(
        resolve(F.col(url), unescape(F.regexp_extract(a, ANCHOR, 1))).alias("href"), clean(unescape(strip_tags(F.regexp_extract(a, ANCHOR, 2)))).alias("text")
    ))
    times = F.regexp_extract_all("_part", F.lit(r"""(?is)<time\b[^>]*?datetime\s*=\s*["']([^"']+)["']"""), F.lit(1))
    items = part.withColumn("links", links)
    others = F.filter("links", lambda p: ~is_document_url(p["href"]))
    first = F.try_element_at(others, F.lit(1))
    out = items.select(
        *keep, "position", F.nullif(first["text"], F.lit("")).alias("title"), first["href"].alias("detail_url"),
        F.transform(F.filter("links", lambda p: is_document_url(p["href"])), lambda p: p["href"]).alias("attachment_urls"),
        F.try_element_at(times, F.lit(-1)).alias("published_at"), clean(unescape(strip_tags(F.col("_part")))).alias("row_text"),
    )
    some = F.col("title").isNotNull() | F.col("detail_url").isNotNull() | (F.size("attachment_urls") > 0)
    return out.filter(some & ~is_landing(F.col("title"), F.col("detail_url")))


# Words that the name of an authority has.
AUTHORITY_WORDS = ["ΔΗΜΟΣ", "ΠΕΡΙΦΕΡΕΙΑ", "ΥΠΟΥΡΓ", "ΕΦΟΡΕΙΑ", "ΑΡΧΗ"]


def extract_html_table_rows(pages: DataFrame, html: str, keep: Sequence[str], seq: Sequence[str], mode: str = "export", authority_words: Sequence[str] = AUTHORITY_WORDS) -> DataFrame:
    """A5: grid rows -> id, title, authority, dates. First row of an id wins; header rows are dropped.

    `mode` export reads fixed columns of an exported sheet, grid reads what the cells look like.
    """
    rows = F.regexp_extract_all(unescape(F.col(html)), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    flat = unnest(pages, list(dict.fromkeys([*keep, *seq])), rows, "_row", "_pos")
    cells = F.transform(F.regexp_extract_all("_row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: clean(unescape(strip_tags(c, scripts=True))))
    if mode == "export":
        cells = F.filter(cells, lambda c: c != "")
    flat = flat.withColumn("cells", cells).filter(F.size("cells") > 0).withColumn("row_text", clean(F.array_join("cells", " ")))
    upper = F.upper(F.col("row_text"))
    header = upper.contains("ΚΑΤΑΣΤΑΣΗ") & upper.contains("CPV") & (upper.contains("ΑΡΧΙΖΕΙ") | upper.contains("ΤΕΛΕΙΩΝΕΙ"))
    cell = lambda i: F.nullif(F.try_element_at("cells", F.lit(i + 1)), F.lit(""))
    registry = F.coalesce(first_system_id(F.element_at("cells", 1)), first_system_id(F.col("row_text"))) if mode == "export" else first_system_id(F.col("row_text"))
    flat = flat.filter(~header).withColumn("official_id", registry).filter(F.col("official_id").isNotNull())
    dates = listing_dates(F.col("row_text"))
    wordy = F.filter("cells", lambda c: ~c.contains(F.col("official_id")) & ~c.rlike(r"^\d{2}[-/]\d{2}[-/]\d{4}.*$") & (F.length(c) >= 10) & ~c.contains("Προβολ"))
    longest = F.array_max(F.transform(wordy, lambda c, i: F.struct(F.length(c).alias("n"), (-i).alias("i"), c.alias("c"))))["c"]
    left_over = clean(F.regexp_replace(F.replace(F.col("row_text"), F.col("official_id"), F.lit(" ")), r"\b\d{2}[-/]\d{2}[-/]\d{4}(?:\s+\d{2}:\d{2}(?::\d{2})?)?\b", " "))
    guess = F.substring(F.coalesce(longest, F.nullif(left_over, F.lit(""))), 1, 300)
    named = F.filter("cells", lambda c: F.exists(F.array(*[F.lit(w) for w in authority_words]), lambda w: F.instr(F.upper(c), w) > 0))
    authority = F.substring(F.try_element_at(named, F.lit(1)), 1, 200)
    if mode == "export":
        title, published, deadline = F.coalesce(cell(2), cell(1), guess), cell(5), cell(7)
        authority = F.coalesce(cell(10), authority)
    else:
        title = F.coalesce(cell(1), guess)
        published = F.try_element_at(dates, F.lit(1))
        deadline = F.when(F.size(dates) > 1, F.element_at(dates, -1))
    out = flat.select(
        *keep, F.struct(*seq, "_pos").alias("_seq"), "official_id", title.alias("title"), authority.alias("authority"), published.alias("published_at"),
        deadline.alias("submission_deadline"), F.substring("row_text", 1, 2000).alias("row_text"),
    )
    return first_wins(out, "official_id", "_seq").drop("_seq")


def _position(text: Column, mark: Column | str, start: Column | None = None) -> Column:
    mark = F.lit(mark) if isinstance(mark, str) else mark
    if start is None:
        return F.instr(text, mark)
    tail = F.instr(F.substr(text, start), mark)
    return F.when(tail > 0, tail + start - 1)


def field_after(text: Column, label: str, ends: Sequence[str]) -> Column:
    """Text between a label and the nearest of its end labels; null when empty or missing."""
    at = _position(text, label)
    start = at + len(label)
    end = F.least(*[_position(text, e, start) for e in ends], F.length(text) + 1)
    value = F.regexp_replace(F.substr(text, start, end - start), r"^[ :]+|[ :]+$", "")
    return F.when(at > 0, F.nullif(value, F.lit("")))


# Labels of a registry detail page: field, label, label of the next field.
DETAIL_LABELS = [
    ("eshidis_id", "ΑΑ Συστήματος:", ["Κωδικός CPV:"]),
    ("title", "Συνοπτικός Τίτλος/Αρ. Διακήρυξης:", ["ΑΑ Συστήματος:"]),
    ("cpv", "Κωδικός CPV:", ["Πρόσθετη περιγραφή"]),
    ("authority", "Αναθέτουσα Αρχή:", ["Τοποθεσίες Έργου:"]),
    ("location", "Τοποθεσίες Έργου:", ["Τίτλος Έργου/Μελέτη:"]),
    ("project_title", "Τίτλος Έργου/Μελέτη:", ["Χρηματοδοτήσεις:"]),
    ("budget_with_vat", "Συνολικός Προϋπολογισμός (με ΦΠΑ):", ["Ημερομηνία Δημοσίευσης:"]),
    ("publication_date", "Ημερομηνία Δημοσίευσης:", ["Καταληκτική"]),
    ("submission_deadline", "Καταληκτική Ημ/νία Υποβολής Προσφορών :", ["Ποσό Κατακύρωσης:"]),
]


def extract_labelled_fields(df: DataFrame, text: str, keep: Sequence[str], labels=DETAIL_LABELS) -> DataFrame:
    """Fields of detail pages."""
    flat = df.select(*keep, clean(unescape(F.col(text))).alias("_text"))
    return flat.select(*keep, *[field_after(F.col("_text"), label, ends).alias(name) for name, label, ends in labels])


def extract_attachment_listing(df: DataFrame, xml: str, keep: Sequence[str], pattern: str = r'(?s)id="t1:\d+:it2::content"[^>]*>(.*?)</span>') -> DataFrame:
    """Declared row count and distinct file names of an attachment fragment."""
    text = unescape(F.col(xml))
    names = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: clean(unescape(strip_tags(x))))
    return df.select(
        *keep, F.regexp_extract(text, r'_rowCount="(\d+)"', 1).try_cast("int").alias("row_count"), F.array_distinct(F.filter(names, lambda x: x != "")).alias("filenames")
    )


# Addresses that are never documents, and wording of those that are.
LINK_SKIP = "(?i)(facebook|twitter|instagram|youtube|linkedin|wp-content/themes|wp-json)"
LINK_WANTED = "(?iu)(pdf|zip|docx?|xlsx?|prokir|diagon|tender|διαγωνισ|διακηρ|προκηρ|πρόσκλη|προσκλη|αποφασ|απόφασ)"


def _decoded(href: Column) -> Column:
    """Percent-decoded address; unchanged where the escapes are malformed."""
    return F.coalesce(F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B"))), href)


def listing_token(html: Column, wanted: str = LINK_WANTED, first: int = 8, sample: int = 20_000) -> Column:
    """Change token of a listing page: hash of its first tender-like links, else of its text."""
    anchors = F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), lambda a: F.struct(
        F.trim(_decoded(F.regexp_extract(a, ANCHOR, 1))).alias("href"), F.substring(clean(strip_tags(F.regexp_extract(a, ANCHOR, 2))), 1, 160).alias("label")
    ))
    usable = F.filter(anchors, lambda a: (F.coalesce(a["href"], F.lit("")) != "") & ~a["href"].rlike("^(#|javascript:|mailto:|tel:)") & ~a["href"].rlike(LINK_SKIP) & F.concat_ws(" ", a["href"], a["label"]).rlike(wanted))
    chosen = F.slice(usable, 1, first)
    body = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    compact = F.substring(F.regexp_replace(body, r"\s+", " "), 1, sample)
    listed = F.array_join(F.transform(chosen, lambda a: F.concat_ws("\t", a["href"], a["label"])), "\n")
    return F.when(F.size(chosen) > 0, F.sha2(listed, 256)).otherwise(F.sha2(compact, 256))


def document_links(df: DataFrame, html: str, keep: Sequence[str], words=("pdf", "doc", "zip", "λήψη", "download", "αρχ")) -> DataFrame:
    """Links of a page that look like attachments, by address or text."""
    found = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(0))
    flat = unnest(df, keep, found, "_a", "position")
    text = F.lower(F.concat_ws(" ", F.regexp_extract("_a", ANCHOR, 2), F.regexp_extract("_a", ANCHOR, 1)))
    test = F.lit(False)
    for word in words:
        test = test | text.contains(word)
    return flat.filter(test).select(*keep, "position", F.regexp_extract("_a", ANCHOR, 1).alias("href"), clean(strip_tags(F.regexp_extract("_a", ANCHOR, 2))).alias("text"))

