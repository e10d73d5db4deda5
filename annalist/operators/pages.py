"""Pages to rows: links, tables, paragraphs and what is read from them.

One small parser runs per page inside ``mapInArrow`` and gives arrays; all
that follows (classifying, joining, deduplicating) is Spark.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from html import unescape
from html.parser import HTMLParser
from itertools import groupby
from operator import itemgetter
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import classify as cl
from annalist.functions import dates as fd
from annalist.functions.identifiers import parse_identifier
from annalist.functions.text import clean, fold_marks, slug, words
from annalist.functions.urls import canonical_url, chamber_of, kind_of, profile_key, query_param
from annalist.operators.sets import first_wins, last_wins
from annalist.session import cut_lineage

#: What a page is read into. Rows are table rows with their cells in order;
#: ``bold`` and ``link`` are a cell's first bold and linked text, ``rest`` is its
#: text outside both; ``section`` names the classes of the elements around.
#: ``plain_rows`` are rows without these three.
PARTS = {
    "links": "array<struct<position:int,href:string,text:string,label:string>>",
    "cells": "array<struct<tab:int,line:int,col:int,text:string,href:string,header:boolean,head:string>>",
    "blocks": "array<struct<position:int,kind:string,text:string,anchors:array<struct<href:string,text:string>>,lines:array<string>,section:string>>",
    "rows": "array<struct<tab:int,line:int,section:string,cells:array<struct<text:string,href:string,link:string,bold:string,rest:string,header:boolean>>>>",
    "plain_rows": "array<struct<tab:int,line:int,section:string,cells:array<struct<text:string,href:string,header:boolean>>>>",
    "text": "string",
}


def squeeze(parts: list[str]) -> str:
    return " ".join((parts[0] if len(parts) == 1 else "".join(parts)).split())


# Addresses that are joined by putting them behind each other, without dots, parameters or fragments.
ORIGIN = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?=[/?#]|$)")
ADDRESS = re.compile(r"(https?://[A-Za-z0-9.-]+)?(?:/[A-Za-z0-9_-][A-Za-z0-9_.-]*)+(?:\?[A-Za-z0-9_=&%.+-]+)?")


class PageReader(HTMLParser):
    """Collects links, table cells, text blocks and the text of one page; of
    these, only what ``parts`` ask for. A closed cell is kept as (text, href,
    header, rows, columns, link, bold, rest)."""

    HOLDERS = ("div", "section", "article", "main", "ul", "ol")
    BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "li", "title")

    def __init__(self, base: str, parts: Sequence[str] = tuple(PARTS)):
        super().__init__(convert_charrefs=True)
        self.base, self._origin = base, None
        self._wants_rows, self._wants_blocks, self._wants_text = "rows" in parts, "blocks" in parts, "text" in parts
        self._wants_tables = self._wants_rows or "plain_rows" in parts or "cells" in parts
        self.links, self.tables, self.blocks = [], [], []
        self._href, self._anchor, self._label = None, [], None
        self._open_tables, self._cell = [], None
        self._block, self._block_anchors = None, []
        self._silent = 0
        self.text, self.sections = [], []
        self._holders, self._bold = [], 0
        self.spans = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs) if attrs else {}
        if tag in ("td", "th"):
            if self._open_tables and self.tables[self._open_tables[-1]]:
                if self._cell is not None:
                    self._close_cell()
                if not self._wants_rows:
                    self._cell = {"parts": [], "href": None, "rows": 1, "cols": 1, "header": tag == "th"}
                else:
                    self._cell = {"parts": [], "bold": [], "link": [], "rest": [], "href": None, "rows": 1, "cols": 1, "header": tag == "th"}
                if a:
                    span = lambda name: int(a[name]) if (a.get(name) or "").isdigit() and int(a[name]) > 0 else 1
                    self._cell["rows"], self._cell["cols"] = span("rowspan"), span("colspan")
                    self.spans = self.spans or self._cell["rows"] > 1 or self._cell["cols"] > 1
        elif tag in ("script", "style"):
            self._silent += 1
        elif tag == "a" and a.get("href"):
            self._href, self._anchor, self._label = self._absolute(a["href"]), [], a.get("aria-label")
        elif tag in self.HOLDERS:
            self._holders.append((tag, a.get("class") or ""))
        elif tag == "b":
            self._bold += 1
        elif tag == "br" and self._block is not None:
            self._block[1].append("\0")
        elif tag == "table" and self._wants_tables:
            self.tables.append([])
            self.sections.append(" ".join(filter(None, [self._section(), a.get("class")])))
            self._open_tables.append(len(self.tables) - 1)
        elif tag == "tr" and self._open_tables:
            self._close_cell()
            self.tables[self._open_tables[-1]].append([])
        if tag in self.BLOCKS and (self._wants_blocks or self._wants_text):
            self._close_block()
            self._block = (tag, [], self._section())

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            if self._cell is not None:
                self._close_cell()
        elif tag in ("script", "style"):
            self._silent = max(0, self._silent - 1)
        elif tag == "a" and self._href is not None:
            anchor = squeeze(self._anchor)
            self.links.append((self._href, anchor, self._label))
            if self._cell is not None and self._cell["href"] is None:
                self._cell["href"] = self._href
            if self._block is not None:
                self._block_anchors.append((self._href, anchor))
            self._href = None
        elif tag == "b":
            self._bold = max(0, self._bold - 1)
            if self._cell is not None and self._wants_rows:
                self._cell["bolded"] = bool(self._cell["bold"])
        elif tag in self.HOLDERS:
            for k in range(len(self._holders) - 1, -1, -1):
                if self._holders[k][0] == tag:
                    del self._holders[k:]
                    break
        elif tag == "table" and self._open_tables:
            self._close_cell()
            self._open_tables.pop()
        if self._block is not None and tag == self._block[0]:
            self._close_block()

    def handle_data(self, data):
        if self._silent:
            return
        if self._href is not None:
            self._anchor.append(data)
        cell = self._cell
        if cell is not None:
            cell["parts"].append(data)
            if self._wants_rows:
                if self._href is not None and cell["href"] is None:
                    cell["link"].append(data)
                if self._bold and not cell.get("bolded"):
                    cell["bold"].append(data)
                if not self._bold and self._href is None:
                    cell["rest"].append(data)
        if self._block is not None:
            self._block[1].append(data)
        if self._wants_text and (self._block is None or self._block[0] != "title"):
            self.text.append(data)

    def handle_cells(self, opening: str, run: str) -> bool:
        """Take a run of cells that hold a text or one link each, and the row's start
        if ``opening`` is one, as if tag by tag; False, and nothing taken, where
        what is open around them or a character reference has a say."""
        if self._href is not None or self._bold or self._block is not None or not self._open_tables or "&" in run and unescape(run) != run:
            return False
        rows = self.tables[self._open_tables[-1]]
        if not opening and not rows:
            return False
        self._close_cell()
        if opening:
            rows.append([])
        row, whole, kind = rows[-1], self._wants_rows, run[1:3]
        header = kind == "th"
        for item in run[4:-10 if run.endswith("</tr>") else -5].split(f"</{kind}><{kind}>"):
            href = None
            if item[:1] == "<":
                href, _, item = item[9:-4].partition('">')
                href = self._absolute(href)
            text = " ".join(item.split())
            if href is None:
                row.append((text, None, header, 1, 1, "", "", text) if whole else (text, None, header, 1, 1))
            else:
                self.links.append((href, text, None))
                row.append((text, href, header, 1, 1, text, "", "") if whole else (text, href, header, 1, 1))
            if item and self._wants_text:
                self.text.append(item)
        return True

    def _section(self):
        return " ".join(c for _, c in self._holders if c)

    def _absolute(self, href):
        if self._origin is None:
            self._origin = (ORIGIN.match(self.base) or ("",))[0]
        if self._origin and (found := ADDRESS.fullmatch(href)):
            return href if found[1] else self._origin + href
        try:
            return urljoin(self.base, href)
        except ValueError:
            return href

    def _close_cell(self):
        cell = self._cell
        if cell is not None:
            text = squeeze(cell["parts"])
            closed = (text, cell["href"], cell["header"], cell["rows"], cell["cols"])
            if self._wants_rows:
                # a part that is all of the text needs no second reading, and no copy
                parts, link, bold, rest = cell["parts"], cell["link"], cell["bold"], cell["rest"]
                closed += (link and (text if link == parts else squeeze(link)) or "", bold and (text if bold == parts else squeeze(bold)) or "",
                           rest and (text if rest == parts else squeeze(rest)) or "")
            self.tables[self._open_tables[-1]][-1].append(closed)
            self._cell = None

    def _close_block(self):
        if self._block is not None:
            whole = "".join(self._block[1])
            lines = [squeeze([line]) for line in whole.split("\0")]
            text = squeeze([whole.replace("\0", "")])
            if self._wants_blocks and (text or self._block_anchors):
                self.blocks.append((self._block[0], text, self._block_anchors, [line for line in lines if line], self._block[2]))
        self._block, self._block_anchors = None, []


# Markup that needs no tolerant reading (tag by tag, or with a run of a row's plain cells as one), and elements
# whose content is no markup.
TAG = r'<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z][-A-Za-z0-9_]*="[^"<>\0]*")*)[ \t\n]*(/?)>'
TAGS = re.compile(rf"()(){TAG}([^<\0]*)")
RUN = r'(?:<{0}>(?:<a href="[^"<>\0]+">[^<\0]*</a>|[^<\0]*)</{0}>)+'
PLAIN = re.compile(rf"(?:(<tr>)?((?:{RUN.format('td')}|{RUN.format('th')})(?:</tr>)?)|{TAG})([^<\0]*)")
ATTRIBUTE = re.compile(r'([A-Za-z][-A-Za-z0-9_]*)="([^"]*)"')
READ_TAGS = frozenset((*PageReader.HOLDERS, *PageReader.BLOCKS, "table", "tr", "td", "th", "a", "b", "br", "script", "style"))
RAW = frozenset(("script", "style", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "math", "svg"))


def feed_plain(reader: PageReader, html: str, markup: re.Pattern = PLAIN) -> bool:
    """Give ``reader`` what HTMLParser finds in a page of nothing but text and
    well-formed tags, an order faster; False, part of the way, for any other."""
    at, inside_title = html.find("<"), False
    if at < 0 or "\0" in html[:at]:
        return False
    # what lies between two matches, and behind the last, is no plain markup
    found = markup.split(html[at:])
    if any(found[::8]):
        return False
    start, end, data = reader.handle_starttag, reader.handle_endtag, reader.handle_data
    if at:
        data(unescape(html[:at]))
    for opening, run, closing, tag, attributes, empty, text in zip(*[found[n::8] for n in range(1, 8)]):
        if run:
            if inside_title or not reader.handle_cells(opening, run) and not feed_plain(reader, (opening or "") + run, TAGS):
                return False
        elif closing:
            tag = tag.lower()
            if attributes or empty or inside_title and tag != "title":
                return False
            inside_title = False
            if tag in READ_TAGS:
                end(tag)
        else:
            tag = tag.lower()
            # what may be a character reference in an attribute is for the library to say
            if inside_title or tag in RAW or "&" in attributes and unescape(attributes) != attributes:
                return False
            if tag in READ_TAGS:
                start(tag, [(name.lower(), value) for name, value in ATTRIBUTE.findall(attributes)] if attributes else ())
            inside_title = tag == "title"
            if empty:
                if inside_title:
                    return False
                if tag in READ_TAGS:
                    end(tag)
        if text:
            if "&" in text:
                if inside_title:
                    return False
                text = unescape(text)
            data(text)
    return not inside_title


def lay_out(rows: list[list[tuple]]) -> Iterator[tuple]:
    """(line, column, cell) with row and column spans filled in; a span that
    runs past the last row ends there."""
    waiting: dict[int, tuple[int, tuple]] = {}
    for line, row in enumerate(rows):
        column, queue = 0, deque(row)
        while queue or any(c >= column for c in waiting):
            if column in waiting:
                left, cell = waiting.pop(column)
                if left > 1:
                    waiting[column] = (left - 1, cell)
                yield line, column, cell
                column += 1
            elif queue:
                cell = queue.popleft()
                for _ in range(cell[4]):
                    if cell[3] > 1:
                        waiting[column] = (cell[3] - 1, cell)
                    yield line, column, cell
                    column += 1
            else:
                column += 1


def read_page(base: str, html: str, parts: Sequence[str]) -> PageReader:
    reader = PageReader(base or "", parts)
    if not feed_plain(reader, html or "", PLAIN if reader._wants_tables else TAGS):
        reader = PageReader(base or "", parts)
        reader.feed(html or "")
        reader.close()
    reader._close_block()
    return reader


def _listed(ends: list[int], **fields: pa.Array) -> pa.Array:
    items = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def _columns(width: int) -> list[list]:
    return [[] for _ in range(width)]


def _links(readers: list[PageReader]) -> pa.Array:
    ends, flat = [0], []
    positions = []
    for reader in readers:
        flat += reader.links
        positions += range(len(reader.links))
        ends.append(len(flat))
    return _listed(ends, position=pa.array(positions, pa.int32()), **{n: pa.array([x[k] for x in flat], pa.string()) for k, n in enumerate(("href", "text", "label"))})


def _cells(readers: list[PageReader]) -> pa.Array:
    ends, (tab, line, col, text, href, header, head) = [0], _columns(7)
    for reader in readers:
        for n, table in enumerate(reader.tables):
            heads = {}
            for at, column, cell in lay_out(table) if reader.spans else ((at, k, cell) for at, row in enumerate(table) for k, cell in enumerate(row)):
                if at == 0:
                    # the last cell of a column counts, for the first line's own cells too
                    heads[column] = cell[0]
                tab.append(n), line.append(at), col.append(column), text.append(cell[0]), href.append(cell[1]), header.append(cell[2])
            head += [heads.get(column) for column in col[len(head):]]
        ends.append(len(tab))
    return _listed(ends, tab=pa.array(tab, pa.int32()), line=pa.array(line, pa.int32()), col=pa.array(col, pa.int32()), text=pa.array(text, pa.string()),
                   href=pa.array(href, pa.string()), header=pa.array(header, pa.bool_()), head=pa.array(head, pa.string()))


def _blocks(readers: list[PageReader]) -> pa.Array:
    ends, anchor_ends, line_ends, anchors, lines, flat, positions = [0], [0], [0], [], [], [], []
    for reader in readers:
        for position, block in enumerate(reader.blocks):
            positions.append(position)
            flat.append(block)
            anchors += block[2]
            lines += block[3]
            anchor_ends.append(len(anchors))
            line_ends.append(len(lines))
        ends.append(len(flat))
    text = lambda k: pa.array([x[k] for x in flat], pa.string())
    return _listed(
        ends, position=pa.array(positions, pa.int32()), kind=text(0), text=text(1),
        anchors=_listed(anchor_ends, href=pa.array([a[0] for a in anchors], pa.string()), text=pa.array([a[1] for a in anchors], pa.string())),
        lines=pa.ListArray.from_arrays(pa.array(line_ends, pa.int32()), pa.array(lines, pa.string())), section=text(4))


def _row_lists(readers: list[PageReader], cell_fields) -> pa.Array:
    ends, cell_ends, (tab, line, section), cells = [0], [0], _columns(3), []
    for reader in readers:
        for n, table in enumerate(reader.tables):
            if not reader.spans:
                laid = ((at, row) for at, row in enumerate(table) if row)
            else:
                laid = ((at, [cell for _, _, cell in group]) for at, group in groupby(lay_out(table), key=itemgetter(0)))
            for at, row in laid:
                tab.append(n), line.append(at), section.append(reader.sections[n])
                cells += row
                cell_ends.append(len(cells))
        ends.append(len(tab))
    fields = list(zip(*cells)) or [()] * 8
    return _listed(ends, tab=pa.array(tab, pa.int32()), line=pa.array(line, pa.int32()), section=pa.array(section, pa.string()),
                   cells=_listed(cell_ends, **cell_fields(lambda k, kind=pa.string(): pa.array(fields[k], kind))))


def _rows(readers: list[PageReader]) -> pa.Array:
    return _row_lists(readers, lambda of: {"text": of(0), "href": of(1), "link": of(5), "bold": of(6), "rest": of(7), "header": of(2, pa.bool_())})


def _plain_rows(readers: list[PageReader]) -> pa.Array:
    return _row_lists(readers, lambda of: {"text": of(0), "href": of(1), "header": of(2, pa.bool_())})


_READ = {"links": _links, "cells": _cells, "blocks": _blocks, "rows": _rows, "plain_rows": _plain_rows, "text": lambda readers: pa.array([squeeze(r.text) for r in readers], pa.string())}

#: Characters of pages that are read before a batch of rows is handed on.
BATCH_CHARS = 4_000_000


def parse(pages: DataFrame, *parts: str) -> DataFrame:
    """pages(page_id, url, html) to one row per page (page_id, url) with the
    asked parts, in the partitions of the input."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            begin, size, readers = 0, 0, []
            urls, pages_html = frame["url"], frame["html"]
            for n in range(frame.num_rows):
                html = pages_html[n].as_py()
                readers.append(read_page(urls[n].as_py(), html, parts))
                size += len(html or "")
                if size >= BATCH_CHARS or n + 1 == frame.num_rows:
                    read = [_READ[p](readers) for p in parts]
                    yield pa.RecordBatch.from_arrays([frame["page_id"].slice(begin, len(readers)), frame["url"].slice(begin, len(readers)), *read], names=["page_id", "url", *parts])
                    begin, size, readers = n + 1, 0, []

    schema = ", ".join(["page_id long", "url string", *[f"{p} {PARTS[p]}" for p in parts]])
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(batches, schema)


def links(pages: DataFrame) -> DataFrame:
    return parse(pages, "links").select("page_id", F.explode("links").alias("x")).select("page_id", "x.*")


def cells(pages: DataFrame) -> DataFrame:
    return parse(pages, "cells").select("page_id", F.explode("cells").alias("x")).select("page_id", "x.*")


def blocks(pages: DataFrame) -> DataFrame:
    return parse(pages, "blocks").select("page_id", F.explode("blocks").alias("x")).select("page_id", "x.*")


def discover(pages: DataFrame) -> DataFrame:
    """Typed links of all pages: canonical address, self-links dropped, one row
    per address (the first page and position)."""
    own = pages.select("page_id", canonical_url(F.col("url")).alias("__own"))
    found = links(pages).withColumn("url", canonical_url(F.col("href"))).join(own, "page_id").where(F.col("url") != F.col("__own"))
    one = first_wins(found.select("url", "page_id", "position", "text"), ["url"], ["page_id", "position"])
    return one.withColumn("kind", kind_of(F.col("url"))).withColumn("chamber", chamber_of(F.col("url")))


def records(all_cells: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Table rows as records: ``wanted`` maps a field to a pattern over the
    folded text of the column's first cell; rows that lack a field are left
    out. The first column that fits a field is taken."""
    field = F.lit(None).cast("string")
    for name, pattern in reversed(wanted.items()):
        field = F.when(words(F.col("head")).rlike(pattern), F.lit(name)).otherwise(field)
    body = all_cells.where(F.col("line") > 0).withColumn("field", field).where(F.col("field").isNotNull())
    first = lambda value, n: F.min_by(value, F.when(F.col("field") == n, F.col("col")))
    rows = body.groupBy("page_id", "tab", "line").agg(
        F.count_distinct("field").alias("n"), *[first("text", n).alias(n) for n in wanted], *[first("href", n).alias(f"{n}_href") for n in wanted])
    return rows.where(F.col("n") == len(wanted)).drop("n")


def nominal_votes(rows: DataFrame) -> DataFrame:
    """records(member, grp, choice) as typed ballots."""
    return rows.select("page_id", "line", F.col("member").try_cast("long").alias("member_id"), F.col("grp").alias("group_id"),
                       cl.choice(F.col("choice")).alias("choice"))


def timeline(rows: DataFrame) -> DataFrame:
    """records(on, label) as dated events, typed, with a chamber."""
    return rows.select("page_id", "line", fd.parse_date(F.col("on")).alias("occurred_on"), clean(F.col("label")).alias("label"),
                       cl.step_type(F.col("label")).alias("step_type"), cl.chamber_in(F.col("label")).alias("chamber"),
                       F.col("label_href").alias("href")).where(F.col("occurred_on").isNotNull())


def listing(rows: DataFrame) -> DataFrame:
    """records(number, title) of a listing as discoveries, with the number of
    rows expected per page."""
    parsed = rows.withColumn("ident", parse_identifier(F.col("number"))).where(F.col("ident").isNotNull())
    # written once, as the counts and the rows would each read all pages
    named = cut_lineage(parsed.select("page_id", "line", F.col("ident.value").alias("official_id"), clean(F.col("title")).alias("title"), F.col("number_href").alias("href")))
    return named.join(named.groupBy("page_id").agg(F.count(F.lit(1)).alias("expected")), "page_id")


def names_document(href: Column) -> Column:
    return F.lower(href).rlike(r"\.(pdf|docx?|html?)($|\?)")


def bill_documents(all_links: DataFrame) -> DataFrame:
    """Document links with label, kind and address hash, one per address and page."""
    docs = all_links.where(names_document(F.col("href")))
    one = first_wins(docs, ["page_id", "href"], ["position"])
    return one.select("page_id", "href", F.col("text").alias("label"), cl.document_kind(F.col("text"), F.col("href")).alias("kind"),
                      F.sha2("href", 256).alias("url_hash"))


def steps_with_document(steps: DataFrame, documents: DataFrame) -> DataFrame:
    """Procedure steps with the hash of the document at their address."""
    d = documents.select("page_id", "url_hash", "kind")
    return steps.withColumn("url_hash", F.sha2("href", 256)).join(d, ["page_id", "url_hash"], "left")


def registry(all_blocks: DataFrame, marker: str) -> DataFrame:
    """Paragraph links to registry files as records, one per address; names come
    from the link's text, the short name from the paragraph first."""
    rows = all_blocks.where("kind = 'p'").select("page_id", "position", F.col("text").alias("paragraph"), F.explode("anchors").alias("a")).select(
        "page_id", "position", "paragraph", F.col("a.href").alias("href"), clean(F.col("a.text")).alias("text")).where(F.col("href").contains(marker))
    one = first_wins(rows, ["href"], ["page_id", "position"])
    return one.select("href", "page_id", cl.position(F.col("text")).alias("position"), cl.legal_name(F.col("text")).alias("legal_name"),
                      cl.short_name(F.col("text"), clean(F.col("paragraph"))).alias("short_name"), cl.leading_date(F.col("text")).alias("listed_date"))


def article_candidates(pages: DataFrame) -> DataFrame:
    """What articles say about a party's history: lines of the fact box, cut at
    its marker words, then the paragraphs' sentences. (page_id, n, kind, hint,
    text, dates, confidence): ``n`` counts all lines and sentences of the page;
    equal ones of a kind and hint count once. A page that says nothing has one
    row of the kind no_candidate."""
    parsed = parse(pages, "blocks", "plain_rows").withColumnRenamed("plain_rows", "rows")
    boxes = F.filter("rows", lambda r: r["section"].contains("infobox"))
    last = F.array_max(F.transform(boxes, lambda r: r["tab"]))
    box = F.array_join(F.transform(F.filter(boxes, lambda r: r["tab"] == last), lambda r: F.array_join(F.transform(r["cells"], lambda c: c["text"]), " ")), " ")
    tagged = lambda kind, texts: F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
    paragraphs = F.flatten(F.transform(F.filter("blocks", lambda b: b["kind"] == "p"), lambda b: cl.sentences(b["text"])))
    lines = parsed.select("page_id", F.posexplode(F.concat(tagged("infobox", cl.box_lines(box)), tagged("paragraph", paragraphs))).alias("n", "x")).select("page_id", "n", "x.*")
    kept = lines.where(cl.speaks_of_history(F.col("text"))).withColumn("hint", cl.event_hint(F.col("text")))
    one = first_wins(kept, ["page_id", "kind", "hint", "text"], ["n"]).withColumn("dates", fd.date_candidates(F.col("text")))
    found = one.withColumn("confidence", F.when(F.size("dates") > 0, "medium").otherwise("low"))
    silent = pages.select("page_id").join(found.select("page_id").distinct(), "page_id", "left_anti").select(
        "page_id", F.lit(0).alias("n"), F.lit("no_candidate").alias("kind"), F.lit("no_candidate").alias("hint"), F.lit(None).cast("string").alias("text"),
        F.array().cast("array<string>").alias("dates"), F.lit("none").alias("confidence"))
    return found.select(*silent.columns).unionByName(silent)


def step_documents(pages: DataFrame) -> DataFrame:
    """(page_id, tab, line, url_hash, kind): the first document link of each
    table row, if the page lists a document of that address."""
    parsed = parse(pages, "links", "plain_rows").withColumnRenamed("plain_rows", "rows")
    linked = lambda c: c["href"].rlike(r"\.pdf$|\.pdf\?|/docs\?")
    linked_rows = F.transform("rows", lambda r: F.struct(r["tab"].alias("tab"), r["line"].alias("line"), F.get(F.filter(r["cells"], linked), F.lit(0))["href"].alias("href")))
    # written once, and no more than the join needs: rows and documents would each read all pages
    kept = cut_lineage(parsed.select("page_id", F.filter(linked_rows, lambda r: r["href"].isNotNull()).alias("rows"), F.filter("links", lambda x: names_document(x["href"])).alias("links")))
    rows = kept.select("page_id", F.explode("rows").alias("r")).select("page_id", "r.*")
    documents = bill_documents(kept.select("page_id", F.explode("links").alias("x")).select("page_id", "x.*"))
    return steps_with_document(rows, documents).where("url_hash IS NOT NULL AND kind IS NOT NULL").select("page_id", "tab", "line", "url_hash", "kind")


def roster_groups(indexes: DataFrame, legislature: str, chamber: str = "deputies") -> DataFrame:
    """Groups that index pages list, by address, with the number of members the
    link's label names (0 for none): (url, group_id, name, short_name, party,
    expected). The first link of an address counts."""
    label = F.coalesce("label", "text")
    found = links(indexes).where(F.col("href").rlike(r"structura(?:2015)?\.gp") & F.col("href").contains("idg=")).withColumn("said", clean(label))
    name = clean(F.regexp_replace("said", r"(?i)\s*-\s*\d+\s*membri.*$", ""))
    number = F.regexp_extract("href", r"(?i)idg=([^&]+)", 1)
    one = first_wins(found.select(F.col("href").alias("url"), name.alias("name"), "said", number.alias("idg"), "page_id", "position").where("name <> ''"), ["url"], ["page_id", "position"])
    known = cl.party_of(F.col("name"))
    named = one.withColumn("party", known)
    key = F.coalesce("party", F.when(F.col("name").rlike("(?i)neafili"), "unaffiliated"), slug(F.concat_ws("-", F.lit(legislature), "idg")))
    expected = F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace("said", r"\s+", ""), r"(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    return named.select("url", F.concat_ws("-", F.lit("group"), F.lit(chamber), key).alias("group_id"), "name", cl.group_short_name(F.col("name")).alias("short_name"), "party", expected.alias("expected"))


# Roles that a group page's row names, and link texts that are no names.
GROUP_ROLES = r"(?i)(?<![A-Za-z0-9_])Lider(?![A-Za-z0-9_])"
NOT_NAMES = "activitate|cv|biografie|declaratii|interpelari|initiative"


def group_role(text):
    leads = text.rlike(GROUP_ROLES) & ~text.rlike("(?i)Vice")
    return F.when(leads, "Lider grup parlamentar").when(text.rlike("(?i)Vicelider"), "Vicelider grup parlamentar").when(
        text.rlike("(?i)Secretar"), "Secretar grup parlamentar")


def group_members(group_pages: DataFrame, groups: DataFrame, starts_on: str) -> DataFrame:
    """Members of group pages, each once per page: (page_id, group_id,
    official_id, display_name, starts_on, role). The page's group is the one an
    index lists at its address. A row that names a role gives it to its own member,
    or else to the next member; a row without a date starts with the window."""
    own = groups.select("url", "group_id")
    parsed = parse(group_pages, "rows").join(own, "url").select("page_id", "group_id", "url", F.posexplode("rows").alias("n", "r"))
    cells = F.filter("r.cells", lambda c: ~c["header"])
    cell = lambda n: clean(F.coalesce(F.get(cells, F.lit(n))["text"], F.lit("")))
    profile = F.get(F.filter("r.cells", lambda c: c["href"].rlike(r"structura(?:2015)?\.mp") & c["href"].contains("idm=")), F.lit(0))
    rows = parsed.select("page_id", "group_id", "url", "n", group_role(F.when(cell(0).rlike(r"^\d+\.?$"), cell(1)).otherwise(cell(0))).alias("said"),
                         F.nullif(F.regexp_extract(profile["href"], r"(?i)idm=(\d+)", 1), F.lit("")).alias("official_id"), clean(profile["link"]).alias("display_name"),
                         profile["bold"].contains(profile["link"]).alias("bold"), F.array_join(F.transform("r.cells", lambda c: c["text"]), " ").alias("text"))
    # a member row is what the role of the row before it, if that named one, can pass to
    linked = F.col("official_id").isNotNull() & (F.col("display_name") != "") & ~fold_marks(F.col("display_name")).rlike(NOT_NAMES)
    linked = linked & (~F.col("url").contains("structura2015.gp") | F.col("bold"))
    first = F.row_number().over(Window.partitionBy("page_id", "official_id", F.coalesce(linked, F.lit(False))).orderBy("n")) == 1
    marked = rows.withColumn("member", F.coalesce(linked, F.lit(False)) & first)
    # pages are bounded, so a page's rows are one window
    along = Window.partitionBy("page_id").orderBy("n")
    since = F.sum(F.when(F.col("member"), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, -1))
    passed = marked.withColumn("turn", F.coalesce(since, F.lit(0)))
    passed = passed.withColumn("role", F.coalesce("said", F.last("said", ignorenulls=True).over(Window.partitionBy("page_id", "turn").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))))
    return passed.where("member").select("page_id", "group_id", "official_id", "display_name", F.coalesce(fd.parse_date(F.col("text")), F.to_date(F.lit(starts_on))).alias("starts_on"), "role")


def history_candidates(all_blocks: DataFrame) -> DataFrame:
    """Sentences that speak of a founding, merger or the like: event hint,
    dates, confidence; equal sentences of a page once."""
    sentences = all_blocks.select("page_id", "position", F.posexplode(cl.sentences(F.col("text"))).alias("n", "text"))
    kept = sentences.where(cl.speaks_of_history(F.col("text")))
    tagged = kept.withColumn("hint", cl.event_hint(F.col("text"))).withColumn("dates", fd.date_candidates(F.col("text")))
    one = first_wins(tagged, ["page_id", "hint", "text"], ["position", "n"])
    return one.withColumn("confidence", F.when(F.size("dates") > 0, "medium").otherwise("low"))


def window_links(all_links: DataFrame) -> DataFrame:
    """Links whose text or address names a period (year-year): one per period,
    the last link of the first page wins."""
    label = F.nullif(F.regexp_extract(F.concat_ws(" ", "text", "href"), r"((?:19|20)\d{2}\s*[-–]\s*(?:19|20)\d{2})", 1), F.lit(""))
    found = all_links.withColumn("period", F.regexp_replace(label, r"\s*–\s*|\s*-\s*", "-")).where(F.col("period").isNotNull())
    return last_wins(found.select("period", "href", "page_id", "position"), ["period"], ["page_id", "position"])


def career_links(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profile pages to (profile, linked profile) edges, replacement relations
    and image links."""
    own = pages.select("page_id", profile_key(F.col("url")).alias("src")).where(F.col("src").isNotNull())
    found = links(pages).join(own, "page_id")
    keyed = found.withColumn("dst", profile_key(F.col("href")))
    edges = keyed.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))).select("src", "dst").distinct()
    replaced = keyed.where(F.col("dst").isNotNull() & words(F.col("text")).rlike("(inlocuieste|inlocuit|replaces)")).select("src", F.col("dst").alias("replaced")).distinct()
    images = found.where(F.lower("href").rlike(r"\.(jpe?g|png|gif|svg)($|\?)")).select(
        "src", "href", F.when(F.lower("href").contains("sigl") | F.lower("href").contains("logo"), "party_logo").otherwise("photo").alias("asset_type")).distinct()
    return edges, replaced, images


def roster(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(member, grp) of roster pages as members and memberships, each
    once, the last row winning."""
    named = rows.where(F.col("member") != "").withColumn("member_id", F.coalesce(query_param(F.col("member_href"), "idm"), slug(F.col("member"))))
    members = last_wins(named.select("member_id", F.col("member").alias("display_name"), "page_id", "line"), ["member_id"], ["page_id", "line"])
    memberships = last_wins(named.select("member_id", F.col("grp").alias("group_name"), "page_id", "line"), ["member_id", "group_name"], ["page_id", "line"])
    return members, memberships
