"""HTML bodies as text by column expressions; as Markdown and made safe by a parser over Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from html import escape, unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lettergraph.functions import rules

#: What goes with all it holds, each up to its own end or, left open, to the page's; a body ends a head left open.
_HIDDEN = (
    r"(?is)<(?:svg|math)\b[^>]*/>|<(script|style|title|template|noscript|svg|math)\b.*?(?:</\1\s*>|\z)|<head\b.*?(?:</head\s*>|(?=<body\b)|\z)"
    r"|<!--.*?(?:-->|\z)|<!doctype[^>]*>"
)
_BLOCK = r"(?is)</?(?:p|div|br|tr|table|ul|ol|li|h[1-6]|blockquote|pre|section|article|header|footer|nav|hr)\b[^>]*>"
_TAG = r"(?is)<[a-z/!][^>]*>"


def _decoded(text: Column) -> Column:
    """Character references as characters, by the table of the HTML standard, once the tags are gone."""
    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unescape(t) for t in batch.to_pylist()], type=pa.string())

    return run(text)


def _tidy(text: Column) -> Column:
    """No zero-width characters, single spaces, at most one blank line."""
    text = F.regexp_replace(F.regexp_replace(text, r"[\x{200B}-\x{200D}\x{FEFF}]", ""), r"[ \t\x{A0}\r]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def html_text(html: Column) -> Column:
    """What a reader sees, a line a block."""
    html = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    return _tidy(_decoded(F.regexp_replace(F.regexp_replace(html, _BLOCK, "\n"), _TAG, "")))


#: Elements that go with all they hold.
DROPPED = frozenset(("script", "style", "form", "iframe", "object", "embed", "head", "template", "noscript", "svg", "math", "applet", "frameset", "textarea", "select", "button"))
#: Elements that may stay in a shown body, with the attributes that may stay on them; of all others only the text stays.
ALLOWED = {
    **{t: () for t in (
        "abbr b big blockquote br caption center cite code col colgroup dd del div dl dt em font h1 h2 h3 h4 h5 h6 hr i ins li mark ol p pre q s small span strike strong "
        "sub sup table tbody tfoot thead tr u ul"
    ).split()},
    "a": ("href",), "img": ("src", "alt", "width", "height"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan"),
}
#: Attributes that may stay on any of them.
ANYWHERE = ("title", "dir", "lang")
_VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "col", "area", "base", "source", "track", "wbr", "embed", "param"))
_LINKS = ("http:", "https:", "mailto:", "tel:", "#", "/", "./", "../")
_IMAGES = ("cid:", "data:image/png", "data:image/jpeg", "data:image/gif", "data:image/webp")
# Classes and ids that mail programs put around quoted mail.
_QUOTE_CLASS = ("gmail_quote", "yahoo_quoted", "moz-cite-prefix", "protonmail_quote")
_QUOTE_ID = ("divrplyfwdmsg", "appendonsend", "replyforwardmessage")


class _Walker(HTMLParser):
    """Walks a document with the elements that are open and what to write at their end; what subclasses write goes to ``out``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, str]] = []
        self.n_open: Counter[str] = Counter()  # by name, so that an end without a beginning costs no walk
        self.skipping = 0
        self.skipped = ""

    def push(self, tag: str, after: str) -> None:
        if tag not in _VOID:
            self.open.append((tag, after))
            self.n_open[tag] += 1

    def pop(self) -> tuple[str, str]:
        tag, after = self.open.pop()
        self.n_open[tag] -= 1
        return tag, after

    def text(self) -> str:
        return "".join([*self.out, *[after for _, after in reversed(self.open)]])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipping and not (self.skipped == "head" and tag == "body"):  # a body ends a head left open
            self.skipping += tag == self.skipped and tag not in _VOID
        elif tag in DROPPED:
            if tag not in _VOID:
                self.skipping, self.skipped = 1, tag
        else:
            self.skipping = 0
            self.start(tag, {k.lower(): v or "" for k, v in reversed(attrs)})

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            self.skipping -= tag == self.skipped
        else:
            self.end(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.data(data)


class _Safe(_Walker):
    """Rebuilds a body from allowed elements and attributes; whatever is written is escaped anew."""

    def __init__(self, quotes: str) -> None:
        super().__init__()
        self.quotes = quotes
        self.cut = 0
        self.folds = 0

    def start(self, tag: str, given: dict) -> None:
        quoted = self.quotes != "keep" and self._is_quote(tag, given)
        if self.cut:
            self.cut += tag not in _VOID
            return self.push(tag, "")
        if quoted and self.quotes == "cut":
            self.cut = 1
            return self.push(tag, "")
        before = _FOLD if quoted and not self.folds else ""
        self.folds += bool(before)
        attributes = "".join(self._attribute(k, given[k]) for k in (*ALLOWED.get(tag, ()), *ANYWHERE) if k in given)
        self.out.append(before + (f"<{tag}{attributes}>" if tag in ALLOWED else ""))
        self.push(tag, (f"</{tag}>" if tag in ALLOWED else "") + ("</details>" if before else ""))

    def end(self, tag: str) -> None:
        """Closes the nearest element of that name and all within it; an end without a beginning is passed over."""
        while self.n_open[tag]:
            name, after = self.pop()
            self.cut = max(self.cut - 1, 0)
            self.folds -= after.endswith("</details>")
            self.out.append(after)
            if name == tag:
                return

    def fold(self) -> None:
        """Quoted mail begins here: close all that is open, and put the rest of the body in one fold."""
        if not self.folds:
            while self.open:
                self.out.append(self.pop()[1])
            self.cut = 0
            self.out.append(_FOLD)
            self.open.append(("", "</details>"))
            self.folds = 1

    def data(self, data: str) -> None:
        if not self.cut:
            self.out.append(escape(data, quote=False))

    def _is_quote(self, tag: str, given: dict) -> bool:
        named = f" {given.get('class', '').lower()} "
        return tag == "blockquote" or any(q in named for q in _QUOTE_CLASS) or given.get("id", "").lower().removeprefix("x_") in _QUOTE_ID

    @staticmethod
    def _attribute(name: str, value: str) -> str:
        plain = "".join(c for c in value if c > " " and c != "\x7f").lower()
        if name == "href" and (not plain.startswith(_LINKS) or plain[:2] in ("//", "/\\")):  # two slashes name another host
            return ""
        if name == "src" and not plain.startswith(_IMAGES):
            return ' data-blocked="src"'
        if name in ("colspan", "rowspan", "width", "height") and not value.strip().rstrip("%").isdecimal():
            return ""
        return f' {name}="{escape(value.strip())}"'


class _Markdown(_Walker):
    """Headings, emphasis by element or style, links, lists, quotes, code and tables; layout tables as plain blocks."""

    _MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`", "s": "~~", "del": "~~"}
    _BLOCKS = frozenset("p div section article header footer nav main aside ul ol table address figure dl dt dd".split())

    def __init__(self) -> None:
        super().__init__()
        self.lists: list[int] = []
        self.tables: list[list] = []
        self.pre = 0

    def start(self, tag: str, given: dict) -> None:
        style = given.get("style", "").replace(" ", "").lower()
        close = ""
        if tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "img" and given.get("alt"):
            self.out.append(f"![{given['alt']}]")
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            close = "\n\n"
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
            close = "\n```\n\n"
        elif tag == "a" and given.get("href"):
            self.out.append("[")
            close = f"]({given['href'].strip()})"
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else -1)
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            number = ""
            if self.lists and self.lists[-1] >= 0:
                self.lists[-1] += 1
                number = f"{self.lists[-1]}. "
            self.out.append("\n" + "  " * max(len(self.lists) - 1, 0) + (number or "- "))
        elif tag == "blockquote":
            self.out.append("\n\n> ")
            close = "\n\n"
        elif tag == "table":
            layout = given.get("role", "").lower() == "presentation" or (given.get("border", "0") in ("", "0") and "cellpadding" in given)
            self.tables.append([layout, 0, 0])
            self.out.append("\n\n")
        elif tag == "tr" and self.tables:
            self.tables[-1][2] = 0
            self.out.append("\n")
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1][0]:
                self.out.append("| " if not self.tables[-1][2] else " | ")
            elif self.tables[-1][2]:
                self.out.append(" ")
            self.tables[-1][2] += 1
        elif tag in self._MARKS and not self.pre:
            close = self._MARKS[tag]
            self.out.append(close)
        elif tag == "span" and ("font-weight:bold" in style or "font-weight:700" in style):
            close = "**"
            self.out.append(close)
        elif tag in self._BLOCKS:
            self.out.append("\n\n")
            close = "\n\n"
        self.push(tag, close)

    def end(self, tag: str) -> None:
        while self.n_open[tag]:
            name, close = self.pop()
            self.out.append(close)
            if name == "pre":
                self.pre -= 1
            elif name in ("ul", "ol") and self.lists:
                self.lists.pop()
                self.out.append("\n" if self.lists else "\n\n")
            elif name == "table" and self.tables:
                self.tables.pop()
                self.out.append("\n\n")
            elif name == "tr" and self.tables and not self.tables[-1][0]:
                self.out.append(" |")
                self.tables[-1][1] += 1
                if self.tables[-1][1] == 1:
                    self.out.append("\n|" + " --- |" * self.tables[-1][2])
            if name == tag:
                return

    def data(self, data: str) -> None:
        self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


class _Events(_Walker):
    """A body as a list of starts, ends and texts, and its lines: where each begins among them, what it says, and whether a rule stands before it.

    A line ends where a block, a cell or a break does, so a label keeps together over the elements it is made of.
    """

    _BREAKS = frozenset("address article aside blockquote body br center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())

    def __init__(self) -> None:
        super().__init__()
        self.events: list[tuple] = []
        self.lines: list[tuple[int, str, bool]] = []
        self.parts: list[str] = []
        self.begins = 0
        self.ruled = False

    def _break(self, tag: str) -> None:
        if tag in self._BREAKS:
            said = " ".join("".join(self.parts).split())
            if said:
                self.lines.append((self.begins, said, self.ruled))
                self.ruled = False
            self.parts = []

    def start(self, tag: str, given: dict) -> None:
        self._break(tag)
        self.ruled |= tag == "hr" or "border-top" in given.get("style", "").replace(" ", "").lower()
        self.events.append(("start", tag, given))

    def end(self, tag: str) -> None:
        self._break(tag)
        self.events.append(("end", tag))

    def data(self, data: str) -> None:
        if data.strip() and not "".join(self.parts).strip():
            self.parts, self.begins = [], len(self.events)
        self.parts.append(data)
        self.events.append(("data", data))

    def quote(self) -> int:
        """The event at which quoted mail begins, right behind what was said before it; their number where none does.

        A line that is a label between rules or after one; an attribution; a first header label, after a rule with two more
        in the next twelve lines, or else with three.
        """
        self._break("body")
        said = [text for _, text, _ in self.lines]
        rule = [bool(_RULE_LINE.match(t)) for t in said]
        for i, text in enumerate(said):
            after_rule = self.lines[i][2] or (i > 0 and rule[i - 1])
            label = len(text) < 200 and _LABEL_LINE.match(text) and (after_rule or sum(c in "-—_=*" for c in text) >= 2)
            attributed = len(text) < 400 and _ATTRIBUTION.search(text) and (_ADDRESS.search(text) or (len(text) <= 140 and sum(c.isdigit() for c in text) >= 4))
            header = _HEADER_FIRST.match(text) and sum(bool(_HEADER_FOLLOW.match(t)) for t in said[i + 1 : i + 13]) >= (2 if after_rule else 3)
            if label or attributed or header:
                while i > 0 and rule[i - 1]:
                    i -= 1
                return self._behind(self.lines[i - 1][0]) if i else 0
        return len(self.events)

    def _behind(self, line: int) -> int:
        """The event after the last text or image of the line that begins at event ``line``."""
        last, at = line, line + 1
        while at < len(self.events):
            event = self.events[at]
            if event[0] != "data" and event[1] in self._BREAKS:
                break
            if (event[0] == "data" and event[1].strip()) or (event[0] == "start" and event[1] == "img"):
                last = at
            at += 1
        return last + 1


_python = lambda pattern: re.compile(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))
_LABEL_LINE = re.compile(r"(?i)^[\s\-—_=*]*" + rules.LABEL + r"[\s\-—_=*]*$")
_RULE_LINE, _ATTRIBUTION, _ADDRESS, _HEADER_FIRST, _HEADER_FOLLOW = map(_python, (rules.DASHES, rules.ATTRIBUTION, rules.ADDRESS_HINT, rules.HEADER_FIRST, rules.HEADER_FOLLOW))
_FOLD = "<details><summary>…</summary>"


def _without_quotes(body: str, quotes: str) -> str:
    """A safe body whose quoted mail, by its element or by its label, is cut or folded."""
    events = _Events()
    events.feed(body)
    events.close()
    begins, safe = events.quote(), _Safe(quotes)
    for i, (kind, *what) in enumerate(events.events):
        if i == begins:
            if quotes == "cut":
                break
            safe.fold()
        getattr(safe, kind)(*what)
    return safe.text()


def _walked(make, html: pa.Array) -> pa.Array:
    """One walker a row of a batch; null is empty."""
    rows = []
    for h in html.to_pylist():
        walker = make()
        walker.feed(h or "")
        walker.close()
        rows.append(walker.text())
    return pa.array(rows, type=pa.string())


def html_markdown(html: Column) -> Column:
    """Headings, emphasis, links, lists, quotes, code and tables kept as Markdown; the rest as text."""
    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return _walked(_Markdown, batch)

    text = F.regexp_replace(run(html), r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\*\*(\s*)\*\*|\x{A0}", " "), r"[ \t\r]+\n", "\n")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit(" \n"))


def safe_html(html: Column, quotes: str = "keep") -> Column:
    """A body rebuilt from allowed elements and attributes: no scripts, styles, forms or frames with what they hold, no handlers,
    links and images by safe schemes only, every element closed.

    Quoted mail is kept, or ``cut``, or put in a ``fold`` (a closed details element) where it begins: at an element that mail
    programs use for it, or at a label, however many elements that is spread over.
    """
    if quotes not in ("keep", "cut", "fold"):
        raise ValueError(quotes)

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        if quotes != "keep":
            return pa.array([_without_quotes(h or "", quotes) for h in batch.to_pylist()], type=pa.string())
        return _walked(lambda: _Safe(quotes), batch)

    return run(html)


def content_ids(html: Column) -> Column:
    """Content ids of inline images that a body wants, lower case, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)cid:([^"'\s>)]+)"""), F.lit(1)), F.lower))


def with_images(html: Column, images: Column) -> Column:
    """struct(html, n_ok, n_fail): wanted images put in as data, once each; ``images`` maps a content id to (mime, data)."""
    wanted = content_ids(html)
    have = F.filter(wanted, lambda c: F.map_contains_key(images, c))
    put = F.aggregate(have, html, lambda text, c: F.replace(text, F.concat(F.lit("cid:"), c), F.concat(F.lit("data:"), F.element_at(images, c)["mime"], F.lit(";base64,"), F.base64(F.element_at(images, c)["data"]))))
    return F.struct(put.alias("html"), F.size(have).alias("n_ok"), (F.size(wanted) - F.size(have)).alias("n_fail"))


def pruned_html(html: Column, sent: Column, cutoff: Column) -> Column:
    """Past the cutoff a body goes; one with images leaves a mark with their number."""
    n = F.regexp_count(html, F.lit("(?i)data:image/"))
    return F.when(sent >= cutoff, html).when(n > 0, F.concat(F.lit("<!-- images removed: "), n.cast("string"), F.lit(" -->")))
