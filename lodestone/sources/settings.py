"""YAML and TOML files as facts: (repo, path, line, keys, value), one row per key, item or line of a block.

`keys` is the path of names from the root of the file; an item of a list is `#` and its line, so that two items never share a path.
A key that opens a map or a list has a null value; an item of a list in brackets has its own row below its key. The path of a
line comes from a stack of indentations folded over the lines of its file, YAML's in Arrow batches and TOML's in column functions; files
are taken up to the readers' 2 MiB, which bounds a fold.

YAML: block maps and lists, quoted keys and scalars, comments, block scalars (a row per line), bracket lists of one line, several
documents. Not read: anchors, tags, maps in braces (their text is the value), escapes within quotes. TOML: tables, arrays of tables, dotted and
quoted keys, inline tables and arrays of one line or several, comments. Cases: null and empty texts give no rows; lines that are neither
key nor item continue the value before them; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = "array<struct<line:int,keys:array<string>,value:string>>"
_KEY = r"""^("[^"]*"|'[^']*'|[^\s"'#\[\]{},][^#]*?)\s*:(?:\s+(.*)|)$"""
_BLOCK = r"^[|>][0-9+-]*$"
_NAMES = r"""("[^"]*"|'[^']*'|[\w-]+)"""


def _bare(text: Column) -> Column:
    """A scalar without its quotes, or without the comment after it; null if nothing is left."""
    quoted = F.regexp_extract(text, r"""^(?:"((?:[^"\\]|\\.)*+)"|'([^']*)')""", 1)
    single = F.regexp_extract(text, r"""^(?:"((?:[^"\\]|\\.)*+)"|'([^']*)')""", 2)
    plain = F.trim(F.regexp_replace(text, r"(^|\s)#.*$", ""))
    return F.when(text.rlike(r"""^["']"""), F.when(text.startswith('"'), quoted).otherwise(single)).when(plain != "", plain)


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), lambda t, i: F.struct((i + 1).cast("int").alias("line"), (F.length(t) - F.length(F.ltrim(t))).alias("indent"), F.trim(t).alias("body")))


def _listed(value: Column, line: Column) -> Column:
    """Items of a list in brackets of one line, as (segment, item)."""
    items = F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), r"\s*,\s*")
    sound = F.filter(F.transform(items, lambda x: _bare(F.trim(x))), lambda x: x.isNotNull())
    return F.when(value.rlike(r"^\[.*\]$"), F.transform(sound, lambda x, i: F.struct(F.concat(F.lit("#"), line.cast("string"), F.lit("."), i.cast("string")).alias("seg"), x.alias("item"))))


def _rows(files: DataFrame, folded: Column) -> DataFrame:
    each = files.filter("text IS NOT NULL AND text <> ''").select("repo", "path", F.explode(folded).alias("f"))
    return each.select("repo", "path", "f.line", "f.keys", "f.value")


def _facts(line: Column, keys: Column, value: Column) -> Column:
    """The row of a value, and those of its items where it is a list in brackets."""
    listed = _listed(value, line)
    own = F.struct(line.alias("line"), keys.alias("keys"), F.when(listed.isNull(), value).alias("value"))
    more = F.transform(listed, lambda x: F.struct(line.alias("line"), F.concat(keys, F.array(x["seg"])).alias("keys"), x["item"].alias("value")))
    return F.concat(F.array(own), F.coalesce(more, F.array().cast(FACT)))


def _yaml_lines(text: str):
    """(line, keys, value) of one YAML text: a stack of (place, name) folded over its lines."""
    stack, block = [], -1
    for line, t in enumerate(_BREAK.split(text), 1):
        body = t.strip(" ")
        if not body:
            continue
        indent = len(t) - len(t.lstrip(" "))
        inside = 0 <= block < indent
        if body[0] == "#" and not inside:
            continue
        if inside:
            yield line, [k for _, k in stack], body
            continue
        if _FRESH.match(body):
            stack, block = [], -1
            continue
        dash = _DASH.match(body).group() if body[0] == "-" else ""
        rest = body[len(dash) :]
        # an item may stand where its list's key does, so items come half a column after
        places = [p for p, x in enumerate(dash) if x == "-"]
        push = [(2 * (indent + p) + 1, f"#{line}-{i}" if i else f"#{line}") for i, p in enumerate(places)]
        key = _PAIR.match(rest)
        if key:
            push.append((2 * (indent + len(dash)), _QUOTES.sub("", key.group(1))))
        if not push:
            yield line, [k for _, k in stack], body
            continue
        raw = (key.group(2) or "") if key else rest
        value = _scalar(raw)
        stack = [x for x in stack if x[0] < push[0][0]] + push
        keys = [k for _, k in stack]
        opens = value is not None and raw[:1] not in ("'", '"') and bool(_OPENS.match(value))
        block = (indent + len(dash) if key else indent) if opens else -1
        listed = None if opens or value is None else _LIST.match(value)
        yield line, keys, None if opens or listed else value
        if listed:
            items = [x for x in (_scalar(x.strip(" ")) for x in _COMMA.split(listed.group(1))) if x is not None]
            for i, x in enumerate(items):
                yield line, [*keys, f"#{line}.{i}"], x


#: The patterns above for Python, where white space is ASCII's and a line's end is what it is to Spark's functions.
_DOT, _END = "[^\n\r\x85\u2028\u2029]", "(?=[\r\x85\u2028\u2029]?\\Z)"
_python = lambda pattern: re.compile(pattern.replace("(.*)", f"({_DOT}*)").replace("#.*", f"#{_DOT}*").replace("\\\\.", "\\\\" + _DOT).replace("$", _END), re.ASCII)
_BREAK, _FRESH, _DASH, _COMMA = re.compile("\r?\n"), _python(r"(?:---|\.\.\.)(?:\s|$)"), _python(r"(?:-\s+)*(?:-$)?"), re.compile(r"\s*,\s*", re.ASCII)
_PAIR, _OPENS, _LIST, _QUOTES, _COMMENT = _python(_KEY), _python(_BLOCK), _python(r"^\[(.*)\]$"), _python(r"""^["']|["']$"""), _python(r"(^|\s)#.*$")
_QUOTED = _python(r"""^(?:"((?:[^"\\]|\\.)*+)"|'([^']*)')""")


def _scalar(text: str) -> str | None:
    """_bare() of one text."""
    if text[:1] in ("'", '"') and text:
        found = _QUOTED.match(text)
        return (found.group(1 if text[0] == '"' else 2) or "") if found else ""
    return (_COMMENT.sub("", text) if "#" in text else text).strip(" ") or None


#: Facts that a task gathers before it hands them on.
HANDED = 50_000


def _yaml_batches(batches):
    for batch in batches:
        at, found = [], ([], [], [])
        texts = batch.column("text")

        def told():
            rows = batch.select(["repo", "path"]).take(pa.array(at, pa.int64()))
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(found[0], pa.int32()), pa.array(found[1], pa.list_(pa.string())), pa.array(found[2], pa.string())], ["repo", "path", "line", "keys", "value"])

        for i in range(len(texts)):
            for fact in _yaml_lines(texts[i].as_py()):
                at.append(i)
                for column, x in zip(found, fact):
                    column.append(x)
            if len(at) >= HANDED:
                yield told()
                at, found = [], ([], [], [])
        if at:
            yield told()


def yaml_facts(files: DataFrame) -> DataFrame:
    """Facts of YAML files (repo, path, text)."""
    some = files.filter("text IS NOT NULL AND text <> ''").select("repo", "path", "text")
    schema = T.StructType([some.schema["repo"], some.schema["path"]]).add("line", T.IntegerType()).add("keys", T.ArrayType(T.StringType())).add("value", T.StringType())
    return some.mapInArrow(_yaml_batches, schema)


def toml_facts(files: DataFrame) -> DataFrame:
    """Facts of TOML files (repo, path, text)."""
    segments = lambda t: F.transform(F.regexp_extract_all(t, F.lit(_NAMES), F.lit(1)), lambda s: F.regexp_replace(s, r"""^["']|["']$""", ""))
    head, pair = r"^(\[{1,2})\s*([^\[\]]+?)\s*\]{1,2}\s*(#.*)?$", r"""^((?:"[^"]*"|'[^']*'|[\w.\s-])+?)\s*=\s*(.+)$"""

    def parsed(x: Column) -> Column:
        table = x["body"].rlike(head)
        opens = F.regexp_extract(x["body"], head, 1) == "[["
        named = F.concat(segments(F.regexp_extract(x["body"], head, 2)), F.when(opens, F.array(F.concat(F.lit("#"), x["line"].cast("string")))).otherwise(F.array().cast("array<string>")))
        raw = F.regexp_extract(x["body"], pair, 2)
        bare = F.regexp_replace(F.when(raw != "", raw).otherwise(x["body"]), r""""[^"]*"|'[^']*'|#.*$""", "")
        deep = F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))
        # the pairs of an inline table
        pairs = F.regexp_extract_all(F.regexp_extract(raw, r"^\{(.*)\}", 1), F.lit(r"""([\w.-]+\s*=\s*(?:"[^"]*"|'[^']*'|\[[^\]]*\]|[^,{}\s]+))"""), F.lit(1))
        return F.struct(
            x["line"].alias("line"), x["body"].alias("body"), ((x["body"] == "") | x["body"].startswith("#")).alias("blank"), table.alias("table"), named.alias("named"), x["body"].rlike(pair).alias("pair"),
            segments(F.regexp_extract(x["body"], pair, 1)).alias("name"), F.when(~raw.rlike(r"^[\[{]\s*(#.*)?$"), _bare(raw)).alias("value"), F.when(raw.startswith("{"), pairs).alias("pairs"), deep.alias("deep"),
        )

    start = F.struct(F.array().cast("array<string>").alias("table"), F.array().cast("array<string>").alias("last"), F.lit(0).alias("deep"), F.array().cast(FACT).alias("out"))

    def step(a: Column, x: Column) -> Column:
        of = lambda table, last, deep, out: F.struct(table.alias("table"), last.alias("last"), deep.cast("int").alias("deep"), out.alias("out"))
        keys = F.concat(a["table"], x["name"])
        inline = F.transform(x["pairs"], lambda p: F.struct(x["line"].alias("line"), F.concat(keys, segments(F.regexp_extract(p, r"^([\w.-]+)", 1))).alias("keys"), _bare(F.regexp_extract(p, r"=\s*(.*)$", 1)).alias("value")))
        rows = F.when(x["pairs"].isNotNull(), F.concat(F.array(F.struct(x["line"].alias("line"), keys.alias("keys"), F.lit(None).cast("string").alias("value"))), inline)).otherwise(_facts(x["line"], keys, x["value"]))
        item = F.concat(a["last"], F.array(F.concat(F.lit("#"), x["line"].cast("string"))))
        text = _bare(F.regexp_replace(x["body"], r"[\]},\s]+$", ""))
        more = F.when(text.isNotNull(), F.concat(a["out"], F.array(F.struct(x["line"].alias("line"), item.alias("keys"), text.alias("value"))))).otherwise(a["out"])
        return (
            F.when(x["blank"], a).when(a["deep"] > 0, of(a["table"], a["last"], a["deep"] + x["deep"], more)).when(x["table"], of(x["named"], x["named"], F.lit(0), a["out"]))
            .when(x["pair"], of(a["table"], keys, F.greatest(x["deep"], F.lit(0)), F.concat(a["out"], rows))).otherwise(a)
        )

    return _rows(files, F.aggregate(F.transform(_lines(F.col("text")), parsed), start, step, lambda a: a["out"]))
