"""Strict documents: JSON and YAML files as rows of records, with findings in place of exceptions.

Files are read by Spark (``binaryFile``), so they may be in any store; parsing runs in tasks. Duplicate keys,
a byte order mark, bad encoding, floats, and files or trees beyond the limits are findings; the file then has no record.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # YAML files then give a finding
    yaml = None

FIELDS = "path string, record string, code string, message string"


@dataclass(frozen=True)
class Limits:
    size: int = 10 << 20
    depth: int = 64
    nodes: int = 100_000


class Refused(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    out: dict[str, object] = {}
    for key, value in pairs:
        if key in out:
            raise Refused("duplicate-key", f"key {key!r} occurs twice")
        out[key] = value
    return out


def _no_float(text: str) -> None:
    raise Refused("float", f"{text} is no integer")


def parse_json(text: str) -> object:
    try:
        return json.loads(text, object_pairs_hook=_no_repeats, parse_float=_no_float, parse_constant=_no_float)
    except ValueError as e:
        raise Refused("syntax", str(e)) from e


def scalar(text: str) -> object:
    """A plain YAML scalar by the core rules: decimal, octal 0o and hex 0x integers, true, false, null; all else is text."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false") and text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    if re.fullmatch("[-+]?[0-9]+", text):
        return int(text)
    if re.fullmatch("0x[0-9a-fA-F]+", text):
        return int(text, 16)
    if re.fullmatch("0o[0-7]+", text):
        return int(text[2:], 8)
    if re.fullmatch(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", text):
        raise Refused("float", f"{text} is no integer")
    return text


def _value(node: object) -> object:
    if node.tag not in ("tag:yaml.org,2002:map", "tag:yaml.org,2002:seq") and not node.tag.startswith("tag:yaml.org,2002:"):
        raise Refused("tag", f"tag {node.tag} is not allowed")
    if isinstance(node, yaml.ScalarNode):
        return scalar(node.value) if node.style is None else node.value
    if isinstance(node, yaml.SequenceNode):
        return [_value(x) for x in node.value]
    pairs = [(_value(k), _value(v)) for k, v in node.value]
    for key, _ in pairs:
        if not isinstance(key, str):
            raise Refused("key", f"key {key!r} is no text")
    return _no_repeats(pairs)


def parse_yaml(text: str) -> object:
    if yaml is None:
        raise Refused("yaml-missing", "no YAML parser is installed")
    try:
        for event in yaml.parse(text, yaml.SafeLoader):
            if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None):
                raise Refused("anchor", "anchors and aliases are not allowed")
        node = yaml.compose(text, yaml.SafeLoader)
    except yaml.YAMLError as e:
        raise Refused("syntax", str(e).split("\n")[0]) from e
    return None if node is None else _value(node)


def measure(value: object, limits: Limits) -> None:
    todo, n = [(value, 1)], 0
    while todo:
        x, depth = todo.pop()
        n += 1
        if depth > limits.depth or n > limits.nodes:
            raise Refused("limit", f"deeper than {limits.depth} or more than {limits.nodes} nodes")
        todo += [(y, depth + 1) for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]


def load(data: bytes, path: str, limits: Limits) -> object:
    if len(data) > limits.size:
        raise Refused("limit", f"larger than {limits.size} bytes")
    if data.startswith(b"\xef\xbb\xbf"):
        raise Refused("encoding", "a byte order mark")
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Refused("encoding", "not UTF-8") from e
    try:
        value = (parse_json if path.endswith(".json") else parse_yaml)(text)
    except RecursionError as e:
        raise Refused("limit", f"deeper than {limits.depth}") from e
    except ValueError as e:  # such as an integer of thousands of digits
        raise Refused("syntax", str(e).split("\n")[0]) from e
    measure(value, limits)
    return value


def canonical(value: object) -> str:
    """Sorted keys, no spaces, text in NFC; floats are refused."""

    def plain(x: object) -> object:
        if isinstance(x, float):
            raise Refused("float", f"{x} is no integer")
        if isinstance(x, str):
            return unicodedata.normalize("NFC", x)
        if isinstance(x, dict):
            return {plain(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError as e:
        raise Refused("encoding", "half of a surrogate pair") from e
    return text


def basis(fact: dict, resources: dict, assumptions: dict, rests_on: dict[str, str], registries: dict | None = None) -> str:
    """The digest of a fact with what it cites and the bases of the facts it rests on."""
    parts = ["fact-v1", canonical({k: v for k, v in fact.items() if k != "section"}), canonical(resources), canonical(assumptions)]
    parts += [canonical(registries)] if registries else []
    text = "\n".join(parts) + "\n" + "\n".join(f"{full} {digest}" for full, digest in sorted(rests_on.items()))
    return hashlib.sha256(text.encode()).hexdigest()


def read(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(path, record, code, message): a file's canonical JSON, or why there is none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((name, canonical(load(bytes(data), name, limits)), None, None))
                except Refused as e:
                    rows.append((name, None, e.code, str(e)))
            yield pd.DataFrame(rows, columns=["path", "record", "code", "message"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("path").rlike(r"\.(json|ya?ml)$"))
    large = files.where(F.col("length") > limits.size)  # not read
    large = large.select("path", F.lit(None).cast("string"), F.lit("limit"), F.lit(f"larger than {limits.size} bytes"))
    return files.where(F.col("length") <= limits.size).select("path", "content").mapInPandas(parse, FIELDS).union(large)


def records(files: DataFrame, list_key: str) -> DataFrame:
    """(path, ord, id, record): the entries of a list in each file, as variants, in their order."""
    if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", list_key):
        raise ValueError(f"{list_key} is no key of a list")
    whole = files.where("record is not null").select("path", F.parse_json("record").alias("v"))
    entries = whole.sparkSession.tvf.variant_explode(F.variant_get(F.col("v").outer(), f"$.{list_key}", "variant"))
    rows = whole.lateralJoin(entries).select("path", F.col("pos").alias("ord"), F.col("value").alias("record"))
    return rows.select("path", "ord", F.try_variant_get("record", "$.id", "string").alias("id"), "record")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of text files, numbered from 1."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    numbered = files.select("path", F.posexplode(F.split("value", "\n")).alias("at", "text"))
    return numbered.select("path", (F.col("at") + 1).alias("line"), "text")


TRACE = r"^(\d+)\.(\d{1,6}) (\S+) (read|write) (0x[0-9a-fA-F]+)(?: = (0x[0-9a-fA-F]+))?$"


def accesses(rows: DataFrame) -> DataFrame:
    """(path, line, t_us, kind, rw, reg, value) of trace lines; others are left out."""
    part = [F.regexp_extract("text", TRACE, k) for k in range(1, 7)]
    found = rows.where(F.col("text").rlike(TRACE)).select(
        "path", "line", (part[0].cast("long") * 1_000_000 + F.rpad(part[1], 6, "0").cast("long")).alias("t_us"), part[2].alias("kind"), part[3].alias("rw"),
        F.conv(F.substring(part[4], 3, 18), 16, 10).cast("decimal(20,0)").alias("reg"), F.when(part[5] != "", F.conv(F.substring(part[5], 3, 18), 16, 10).cast("decimal(20,0)")).alias("value"),
    )
    return found


def receipts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON receipts of a folder, one to a file; what doesn't parse is left out."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
