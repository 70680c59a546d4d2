"""Reading HTML as columns: tags and attributes by pattern, page text by a parser that runs over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeledger import catalogs as cat
from placeledger.functions import text as tx

_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*" + _VALUE + r"[^>]*>(.*?)(?=</a\s*>|<a\s|\z)"
_ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    """The entities that occur in attributes and link texts, decoded."""
    for entity, plain in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def anchors(html: Column) -> Column:
    """Array of (href, text) of all links with an href, in page order; texts are stripped of tags and collapsed."""
    def parts(i: int) -> Column:
        return F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(i))

    whole = F.arrays_zip(parts(1).alias("a"), parts(2).alias("b"), parts(3).alias("c"), parts(4).alias("inner"))
    plain = lambda inner: tx.collapse(unescape(F.regexp_replace(inner, r"(?s)<!--.*?-->|<[^>]*>", " ")))
    return F.transform(whole, lambda m: F.struct(
        unescape(F.concat(m["a"], m["b"], m["c"])).alias("href"), plain(m["inner"]).alias("text")
    ))


def meta_content(html: Column, attribute: str, value: str) -> Column:
    """Content of the first meta tag with the given attribute value, trimmed; "" if there is none."""
    tag = rf"""(?is)<meta\s(?=[^>]*?\b{attribute}\s*=\s*["']?{value}["'\s/>])[^>]*?\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.trim(unescape(F.concat(F.regexp_extract(html, tag, 1), F.regexp_extract(html, tag, 2))))


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)
    return F.when(html.rlike(r"(?i)<title[\s>]"), tx.collapse(unescape(found)))


def json_ld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?is)" + cat.JSON_LD_PATTERN), F.lit(1))


_TEXT_TYPE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("tight", T.StringType()), T.StructField("spaced", T.StringType()),
])


def _text_udf():
    @F.pandas_udf(_TEXT_TYPE)
    def page_text(pages: pd.Series) -> pd.DataFrame:
        from html.parser import HTMLParser

        void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
        hidden = {"script", "style", "template"}

        class Reader(HTMLParser):
            """Visible text pieces of a page and of its paragraphs. An end tag closes the nearest open one."""

            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.open, self.buffer, self.pieces, self.paragraphs = [], [], [], []

            def flush(self):
                piece = "".join(self.buffer).strip()
                self.buffer = []
                if piece and not (self.open and self.open[-1][0] in hidden):
                    self.pieces.append(piece)
                    for _, held in self.open:
                        if held is not None:
                            held.append(piece)

            def handle_starttag(self, tag, attrs):
                self.flush()
                if tag in void:
                    return
                held = None
                if tag == "p":
                    held = []
                    self.paragraphs.append(held)
                self.open.append((tag, held))

            def handle_startendtag(self, tag, attrs):
                self.handle_starttag(tag, attrs)
                self.handle_endtag(tag)

            def handle_endtag(self, tag):
                self.flush()
                if any(name == tag for name, _ in self.open):
                    while self.open.pop()[0] != tag:
                        pass

            def handle_comment(self, data):
                self.flush()

            def handle_decl(self, decl):
                self.flush()

            def handle_data(self, data):
                self.buffer.append(data)

        def read(html):
            if html is None:
                return None, None, None
            reader = Reader()
            reader.feed(html)
            reader.close()
            reader.flush()
            first = lambda glue: next((t for t in map(glue.join, reader.paragraphs) if len(t) > 40), None)
            return " ".join(reader.pieces), first(""), first(" ")

        return pd.DataFrame([read(h) for h in pages], columns=["text", "tight", "spaced"])

    return page_text


page_text = _text_udf()
