"""XML text columns."""

from __future__ import annotations

import codecs
import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What nodes() returns; types, not DDL text, so that the module imports without a session.
NODES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("depth", T.IntegerType())]))


#: An & that begins no reference to an entity or a character.
_BARE = r"&(?!(?:[A-Za-z#_:]|[^\x00-\x7f])(?:[A-Za-z0-9_:.-]|[^\x00-\x7f])*;)"


def escape(text: Column, quotes: bool = False, keep_references: bool = False) -> Column:
    """< > & as entities, with quotes also " and '; keep_references leaves alone what is a reference already."""
    text = F.regexp_replace(text, _BARE, "&amp;") if keep_references else F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;")) if quotes else out


def unescape(text: Column) -> Column:
    """The five entities of XML itself."""
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


@F.pandas_udf(T.StringType())
def unescape_html(text):  # noqa: ANN001, ANN201
    """All entity names of HTML, and references by number."""
    return text.map(html.unescape, na_action="ignore")


#: What holds no tags: comments, CDATA sections, processing instructions, declarations.
_OTHER = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>"
#: The rest of a tag after its name: quoted values are units, so a > within them ends nothing.
_REST = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_NAME = r"[A-Za-z_:\x{80}-\x{10ffff}][^\s/>]*"


def attribute(text: Column, tag: str, name: str) -> Column:
    """Unescaped value of an attribute of the first element of that name, quoted or not; null without one.

    Tags in comments and CDATA sections are none; a name ends at a blank, / or >; quotes of the other kind are data.
    """
    inner = F.get(F.regexp_extract_all(F.regexp_replace(text, _OTHER, ""), F.lit(rf"<\Q{tag}\E(?=[\s/>]){_REST}"), F.lit(1)), F.lit(0))
    one = r"""\s+[^\s=/>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'][^\s]*))?"""
    found = F.regexp_extract(inner, rf"""^(?:{one})*?\s+\Q{name}\E\s*=\s*("[^"]*"|'[^']*'|[^\s"'][^\s]*)""", 1)
    value = F.when(F.substring(found, 1, 1).isin('"', "'"), F.regexp_replace(found, r"""(?s)^["'](.*)["']$""", "$1")).otherwise(found)
    return F.when(found != "", unescape(value))


def elements(text: Column) -> Column:
    """Names of elements in document order: the depth-first walk. Tags in comments and CDATA sections are none."""
    return F.regexp_extract_all(F.regexp_replace(text, _OTHER, ""), F.lit(rf"<({_NAME})(?=[\s/>]){_REST}"), F.lit(1))


_TOKEN = re.compile(r"""<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?(?P<pi>.*?)\?>|<!(?P<doctype>[^>\[]*(?:\[.*?\])?[^>]*)>|</\s*(?P<end>[^\s>]+)\s*>|<(?P<start>[^\s/>!?<]+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<text>[^<]+|<)""", re.S)


def _tree(x: str) -> list[dict]:
    """All nodes of a text in document order, whatever its faults: kind, begin, end (places in x), name, value, depth, and of
    elements also inner and outer, the places before and after the end tag (None without one).

    An end tag closes the last open element of its name; elements still open within that, or at the end of the text, have
    no content of their own. An end tag that closes nothing is no node.
    """
    out, opened = [], []
    for m in _TOKEN.finditer(x):
        kind = m.lastgroup if m["start"] is None else "start"
        if kind == "end":
            at = next((k for k in range(len(opened) - 1, -1, -1) if out[opened[k]]["name"] == m["end"]), None)
            if at is not None:
                out[opened[at]] |= {"inner": m.start(), "outer": m.end()}
                del opened[at:]
            continue
        node = {"kind": "element" if kind == "start" else kind, "begin": m.start(), "end": m.end(), "name": None, "value": m[kind], "inner": None, "outer": None}
        if kind == "start":
            rest = m["rest"]
            # The slash of an unquoted value is the value's.
            empty = rest.endswith("/") and not re.search(r"=\s*[^\s\"'=]*/$", rest)
            node |= {"name": m["start"], "value": (rest[:-1] if empty else rest).strip()}
            if not empty:
                opened.append(len(out))
        elif kind in ("pi", "doctype"):
            word = m[kind].split(None, 2)
            node |= {"name": word[0] if kind == "pi" and word else word[1] if len(word) > 1 else None, "value": m[kind].partition(" ")[2] if kind == "pi" else None}
        elif kind == "text" and not m["text"].strip() and not opened:
            continue  # blanks between top-level nodes
        out.append(node)
    ends: list[int] = []
    for node in out:
        while ends and ends[-1] <= node["begin"]:
            ends.pop()
        node["depth"] = len(ends)
        if node["inner"] is not None:
            ends.append(node["inner"])
    return out


def _plain(value: str) -> str:
    return html.unescape(value) if "&" in value else value


def _at(tree: list[dict], path: str) -> list[int]:
    """Places in the tree of the elements at a path of names from the top."""
    names, here, out = path.strip("/").split("/"), [], []
    for k, node in enumerate(tree):
        if node["kind"] == "element":
            del here[node["depth"] :]
            here.append(node["name"])
            if here == names:
                out.append(k)
    return out


def _data(tree: list[dict], k: int) -> str:
    """Text and CDATA of an element without child elements, unescaped; of one with children, none."""
    node, parts = tree[k], []
    for child in tree[k + 1 :] if node["inner"] is not None else []:
        if child["begin"] >= node["inner"]:
            break
        if child["kind"] == "element":
            return ""
        if child["kind"] in ("text", "cdata"):
            parts.append(child["value"] if child["kind"] == "cdata" else _plain(child["value"]))
    return "".join(parts)


def find(text: Column, path: str) -> Column:
    """Data of the elements at a path of names, in order: an array. Ill-formed text is searched like any other (see nodes)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(texts):  # noqa: ANN001, ANN202
        def each(x: str) -> list[str]:
            tree = _tree(x)
            return [_data(tree, k) for k in _at(tree, path)]

        return texts.map(each, na_action="ignore")

    return found(text)


def _edit(text: Column, path: str, change: Callable[[str, dict], str], *more: Column) -> Column:
    """text after change(text, node, ...) at the first element of the path; unchanged without one."""

    @F.pandas_udf(T.StringType())
    def edited(texts, *values):  # noqa: ANN001, ANN002, ANN202
        def each(x: str, *v: str) -> str:
            if x is None or any(y is None for y in v):
                return x
            tree = _tree(x)
            return next((change(x, tree[k], *v) for k in _at(tree, path)), x)

        return pd.Series([each(*row) for row in zip(texts, *values)], dtype=object)

    return edited(text, *more)


def remove_element(text: Column, path: str) -> Column:
    """Text without the first element at the path, content and all."""
    return _edit(text, path, lambda x, n: x[: n["begin"]] + x[n["outer"] or n["end"] :])


def set_data(text: Column, path: str, data: Column) -> Column:
    """Text with escaped data as the whole content of the first element at the path; null data change nothing."""

    def change(x: str, n: dict, value: str) -> str:
        if n["outer"]:
            return x[: n["end"]] + value + x[n["inner"] :]
        head = x[n["begin"] : n["end"] - 1].rstrip("/").rstrip()
        return f"{x[: n['begin']]}{head}>{value}</{n['name']}>{x[n['end'] :]}"

    return _edit(text, path, change, escape(data))


def set_attribute(text: Column, path: str, name: str, value: Column) -> Column:
    """Text with the attribute, added or changed, of the first element at the path; a null value changes nothing."""
    pattern = re.compile(rf"""(?:^|(?<=\s)){re.escape(name)}\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"']\S*)""")

    def change(x: str, n: dict, v: str) -> str:
        own = f'{name}="{v}"'
        # Quoted values are blanked for the search, so a name within one is not found.
        flat = re.sub(r"\"[^\"]*\"|'[^']*'", lambda q: q[0][0] + "_" * (len(q[0]) - 2) + q[0][-1], n["value"])
        if m := pattern.search(flat):
            inner = n["value"][: m.start()] + own + n["value"][m.end() :]
        else:
            inner = f"{n['value']} {own}".strip()
        slash = "/" if x[n["begin"] : n["end"]].rstrip(">").endswith("/") and not n["value"].endswith("/") else ""
        return f"{x[: n['begin']]}<{n['name']} {inner}{slash}>{x[n['end'] :]}"

    return _edit(text, path, change, escape(value, quotes=True))


def add_child(text: Column, path: str, content: Column, first: bool = False) -> Column:
    """Text with a subdocument (element(), escaped text, CDATA) as last or first child of the first element at the path."""

    def change(x: str, n: dict, v: str) -> str:
        if n["outer"]:
            at = n["end"] if first else n["inner"]
            return x[:at] + v + x[at:]
        head = x[n["begin"] : n["end"] - 1].rstrip("/").rstrip()
        return f"{x[: n['begin']]}{head}>{v}</{n['name']}>{x[n['end'] :]}"

    return _edit(text, path, change, content)


def cdata(text: Column) -> Column:
    """A CDATA section; an end mark within the text is split over two."""
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def well_formed(text: Column) -> Column:
    """Whether an XML parser takes it. Python's parser in Arrow batches: Spark has no test that doesn't fail the query."""
    return _fault(text) == ""


def fault(text: Column) -> Column:
    """What an XML parser says of the first fault, with line and column; null if the text is well formed."""
    found = _fault(text)
    return F.when(found != "", found)


@F.pandas_udf(T.StringType())
def _fault(text):  # noqa: ANN001, ANN202
    from xml.parsers import expat

    def each(x: str) -> str:
        try:
            expat.ParserCreate().Parse(x, True)
        except expat.ExpatError as e:
            return str(e)
        return ""

    return text.map(each, na_action="ignore")


@F.pandas_udf(NODES)
def nodes(text):  # noqa: ANN001, ANN201
    """All nodes in document order: element, text, cdata, comment, pi, doctype, with their depth.

    Ill-formed text has nodes too: a start tag that no end tag closes is an element without content, and an end tag that
    closes nothing is left out.
    """
    return text.map(lambda x: [{k: _plain(n[k]) if k == "value" and n["kind"] == "text" else n[k] for k in ("kind", "name", "value", "depth")} for n in _tree(x)], na_action="ignore")


def element(name: str, *content: Column, **attributes: Column) -> Column:
    """An element of escaped attributes around given content (escape text first)."""
    head = [F.concat(F.lit(f' {k}="'), escape(v, quotes=True), F.lit('"')) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *head, F.lit(">"), *content, F.lit(f"</{name}>"))


def declared_encoding(text: Column) -> Column:
    """The encoding that an XML declaration or an HTML meta tag names, else null."""
    found = F.regexp_extract(text, r"(?i)(?:<\?xml[^>]*\bencoding|<meta[^>]*\bcharset)\s*=\s*[\"']?([A-Za-z0-9_.-]+)", 1)
    return F.when(found != "", found)


#: Byte order marks, the longer ones first, and what they say.
_MARKS = ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE"))


def is_utf8(content: Column) -> Column:
    """Whether bytes are UTF-8."""
    return F.is_valid_utf8(content.cast("string"))


def encoding_of(content: Column) -> Column:
    """The encoding of a file's bytes: by its byte order mark, else by zero bytes of a first < in UTF-16, else UTF-8 if the
    bytes are that, else as declared, else ISO-8859-1."""
    head = F.hex(F.substring(content, 1, 4))
    marked = F.coalesce(*(F.when(head.startswith(mark.hex().upper()), F.lit(name)) for mark, name in _MARKS))
    bare = F.when(head.startswith("3C00"), F.lit("UTF-16LE")).when(head.startswith("003C"), F.lit("UTF-16BE"))
    told = F.upper(declared_encoding(F.decode(content, "ISO-8859-1")))
    return F.coalesce(marked, bare, F.when(is_utf8(content), F.lit("UTF-8")), told, F.lit("ISO-8859-1"))


@F.pandas_udf(T.StringType())
def decoded(content, encoding):  # noqa: ANN001, ANN201
    """Text of bytes in an encoding that Python knows, without a byte order mark; what can't be read becomes U+FFFD."""
    return pd.Series([None if x is None or e is None else bytes(x).decode(e, "replace").removeprefix("﻿") for x, e in zip(content, encoding)], dtype=object)


@F.pandas_udf(T.BinaryType())
def encoded(text, encoding):  # noqa: ANN001, ANN201
    """Bytes of a text in an encoding; characters that it lacks become references by number."""
    return pd.Series([None if x is None or e is None else x.encode(e, "xmlcharrefreplace") for x, e in zip(text, encoding)], dtype=object)
