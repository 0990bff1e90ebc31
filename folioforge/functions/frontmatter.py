"""What has no built-in expression: front-matter parsing, YAML to JSON, masks, NFKC and FNV-1a. Arrow-batched."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

TEXT = StringType()
FIELDS = StructType(
    [StructField(x, BooleanType()) for x in ("wiki", "fragment")]
    + [StructField(x, TEXT) for x in ("title", "summary")]
    + [StructField(x, ArrayType(TEXT)) for x in ("tags", "related", "aliases")]
    + [StructField("body", TEXT), StructField("line_end", IntegerType())]
)
LISTS, SCALARS, FLAGS = ("tags", "related", "aliases"), ("title", "summary"), ("wiki", "fragment")


def _plain(s: str) -> str:
    s = s.strip()
    return s[1:-1] if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'" else s


def _flag(s: str) -> bool | None:
    return {"true": True, "yes": True, "false": False, "no": False}.get(s.strip().lower())


def parse(content: str) -> dict:
    """Front matter by lines, not YAML: indentation is ignored, later keys win, a bare value of a list is one item."""
    out: dict = {"wiki": None, "fragment": None, "title": None, "summary": None, "tags": [], "related": [], "aliases": [], "body": content, "line_end": 0}
    if not content.startswith("---\n"):
        return out
    end = re.search(r"^---$", content[4:], re.M)
    if end is None:
        return out
    out["body"] = content[4 + end.end() + 1 :]
    block = content[4 : 4 + end.start()].splitlines()
    out["line_end"] = len(block) + 2
    key = None  # of a list that is open
    for line in map(str.lstrip, block):
        if key is not None and line.startswith("- "):
            if key in LISTS:
                out[key].append(_plain(line[2:]))
            continue
        if not line:
            continue
        if line.startswith("#") or ":" not in line:
            key = None
            continue
        name, value = (x.strip() for x in line.split(":", 1))
        key = None
        if not value:
            key = name
            if name in LISTS:
                out[name] = []
        elif name in LISTS:
            inner = value[1:-1].split(",") if value.startswith("[") and value.endswith("]") else [value]
            out[name] = [_plain(x) for x in inner if x.strip()]
        elif name in SCALARS:
            out[name] = _plain(value)
        elif name in FLAGS:
            out[name] = _flag(value)
    return out


@F.pandas_udf(FIELDS)
def front_matter(content: pd.Series) -> pd.DataFrame:
    rows = [parse(x or "") for x in content]
    return pd.DataFrame(rows, columns=FIELDS.names)


@F.pandas_udf(TEXT)
def yaml_json(content: pd.Series) -> pd.Series:
    """Front matter as real YAML, as JSON text (null where there is none or it can't be read)."""
    import yaml

    def one(text: str | None) -> str | None:
        if not text or not text.startswith("---\n"):
            return None
        lines = text[4:].split("\n")
        end = next((i for i, x in enumerate(lines) if x.strip() == "---"), None)
        if end is None:
            return None
        try:
            return json.dumps(yaml.safe_load("\n".join(lines[:end])), default=str)
        except yaml.YAMLError:
            return None

    return content.map(one)


def value_text(value) -> str | None:
    """A YAML value as text: scalars as they are, lists joined by lines, maps as YAML."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "\n".join(x for x in map(value_text, value) if x is not None) or None
    if isinstance(value, dict):
        import yaml

        return yaml.safe_dump(value, sort_keys=False).strip()
    return str(value)


def yaml_field(path: str):
    """A UDF from JSON text to the text at a dotted path of maps."""

    @F.pandas_udf(TEXT)
    def field(found: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            value = json.loads(text) if text else None
            for name in path.split("."):
                value = value.get(name) if isinstance(value, dict) else None
            return value_text(value)

        return found.map(one)

    return field


_BLANK = re.compile(r"[^\n]")
_COMMENT = re.compile(r"<!--.*?(-->|\Z)", re.S)
_CODE = re.compile(r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
_LINK = re.compile(r"!?\[\[[^\[\]\n]+\]\]")
#: Stands between the brackets of what only looks like a link; no text has it.
SHIELD = "\x01"


def mask(text: str) -> str:
    """Comments, inline code and fenced blocks blanked out at equal length. Line breaks stay."""
    blank = lambda m: _BLANK.sub(" ", m.group())
    out, fenced = [], False
    for line in text.split("\n"):
        mark = line.lstrip()[:3] in ("```", "~~~")
        out.append(" " * len(line) if fenced or mark else line)
        fenced ^= mark
    return _CODE.sub(blank, _COMMENT.sub(blank, "\n".join(out)))


@F.pandas_udf(TEXT)
def masked(body: pd.Series) -> pd.Series:
    return body.map(lambda x: None if x is None else mask(x))


@F.pandas_udf(TEXT)
def shielded(body: pd.Series) -> pd.Series:
    """Text in which no link that touches a comment, inline code or a fenced block looks like one."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        bare = mask(text)
        return _LINK.sub(lambda m: m.group() if bare[m.start() : m.end()] == m.group() else m.group().replace("[[", f"[{SHIELD}["), text)

    return body.map(one)


def with_shields(rows: DataFrame, column: str) -> DataFrame:
    """rows with `shielded` of a column in its place; only texts that have links and marks of code or comments go to Python."""
    risky = F.coalesce(F.col(column).contains("[[") & F.col(column).rlike("`|~~~|<!--"), F.lit(False))
    return rows.where(~risky).unionByName(rows.where(risky).withColumn(column, shielded(column)))


@F.pandas_udf(TEXT)
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalised(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with `out`, the NFKC form of a column; ASCII, which is its own form, does not go to Python."""
    odd = F.coalesce(F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(False))
    return rows.where(~odd).withColumn(out, F.col(column)).unionByName(rows.where(odd).withColumn(out, nfkc(column)))


@F.pandas_udf(TEXT)
def fnv1a(content: pd.Series) -> pd.Series:
    """FNV-1a of 64 bits as 16 hex digits."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        h = 0xCBF29CE484222325
        for b in raw:
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return content.map(one)
