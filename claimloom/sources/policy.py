"""Policy files as tables: ``spark.read.format("claim_policy").option("kind", ...).load(path)``.

A line of a policy file is a declaration, a comment (``#``), or a mistake; a mistake is a row too, with ``warning`` set and
nothing declared. Kinds and their columns, after file, line and warning:

- names: name
- aliases: raw, canonical, from ``- `raw` -> `canonical` ``
- hierarchy: relation, child, parent, from ``- relation: child ⊂ parent`` (or ``<:``)
- types: relation, type, alias, units, from ``- `relation` : amount as cost (억=1e8)``
- synonyms: members, from ``- `a` = `b` = `c` ``
- ignore: pattern, a glob
- questions: id, question, from ``- [q1] text``

Names come in normal form C. Each file is a partition, read where the task runs by Arrow's file systems, so a path may be
a local folder or any URI that Arrow opens. A missing path is an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "claim_policy"
COLUMNS = {
    "names": "name string", "aliases": "raw string, canonical string", "hierarchy": "relation string, child string, parent string",
    "types": "relation string, type string, alias string, units map<string,long>", "synonyms": "members array<string>", "ignore": "pattern string", "questions": "id string, question string",
}
# The forms of declarations.
QUOTED = r"`([^`]+)`"
ALIAS = re.compile(rf"{QUOTED}\s*->\s*{QUOTED}")
HIERARCHY = re.compile(r"(?:`(?P<qr>[^`]+)`|(?P<r>[^`:]+?))\s*:\s*(?:`(?P<qc>[^`]+)`|(?P<c>[^`]+?))\s*(?:⊂|<:)\s*(?:`(?P<qp>[^`]+)`|(?P<p>[^`⊂]+?))")
TYPED = re.compile(r"(?:`(?P<q>[^`]+)`|(?P<n>\S+))\s*:\s*(?P<type>\w+)\s+as\s+(?P<alias>\w+)\s*(?:\((?P<units>[^)]*)\))?")
SYNONYMS = re.compile(r"`[^`]+`(?:\s*=\s*`[^`]+`)+")
TYPES = ("date", "number", "ordinal", "amount")


def _nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text.strip())


def _units(body: str | None) -> dict[str, int] | None:
    """``억=1e8, 만=1e4`` as whole positive factors; a ValueError for what is none."""
    if body is None:
        return None
    units: dict[str, int] = {}
    for pair in filter(None, map(str.strip, body.split(","))):
        unit, sign, value = (x.strip() for x in pair.partition("="))
        try:
            factor = Decimal(value)
        except InvalidOperation:
            factor = Decimal(0)
        if not unit or not sign or unit in units or not factor.is_finite() or factor <= 0 or factor != factor.to_integral_value():
            raise ValueError(f"not a unit: {pair}")
        units[unit] = int(factor)
    return units


def _declared(kind: str, text: str, nth: int) -> tuple | str | None:
    """A line's declaration; the reason why it is none; or None where it means to be none."""
    if kind == "names":
        found = re.search(QUOTED, text)
        return (_nfc(found[1] if found else text.split()[0]),)
    if kind == "ignore":
        found = re.fullmatch(QUOTED, text)
        return (_nfc(found[1] if found else text),)
    if kind == "aliases":
        bare = text[: m.start()].strip() if (m := re.search("#", re.sub("`[^`]*`", lambda q: "`" * len(q[0]), text))) else text
        found = ALIAS.fullmatch(bare)
        if not found:
            return f"not a mapping: {text}" if re.search("->|=>|[→⟶↦⇒]", bare) or len(re.findall(QUOTED, bare)) > 1 else None
        pair = _nfc(found[1]), _nfc(found[2])
        return f"maps a name to itself: {text}" if pair[0] == pair[1] else pair
    if kind == "hierarchy":
        found = HIERARCHY.fullmatch(text)
        if not found:
            return f"not a declaration: {text}"
        parts = tuple(_nfc(found[f"q{x}"] or found[x]) for x in "rcp")
        return f"a value as its own parent: {text}" if parts[1] == parts[2] else parts
    if kind == "types":
        found = TYPED.fullmatch(re.sub(r"\s*#.*$", "", text))
        if not found:
            return f"malformed: {text}"
        if found["type"] not in TYPES:
            return f"unknown type: {found['type']}"
        if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", found["alias"]):
            return f"not an identifier: {found['alias']}"
        if found["units"] is not None and found["type"] != "amount":
            return f"units without an amount: {text}"
        try:
            return _nfc(found["q"] or found["n"]), found["type"], found["alias"], _units(found["units"])
        except ValueError as error:
            return str(error)
    if kind == "synonyms":
        if not SYNONYMS.fullmatch(text):
            return f"not a group: {text}" if "=" in text or "`" in text else None
        members = list(dict.fromkeys(_nfc(x) for x in re.findall(QUOTED, text)))
        if not all(x.isprintable() for x in members):
            return f"an unprintable character: {text!r}"
        return (members,) if len(members) > 1 else f"a group of one: {text}"
    if re.match(r"\[[ xX]\]\s", text):
        return f"a check box: {text}"
    found = re.fullmatch(r"\[([\w-]+)\]\s*(.+)", text, re.ASCII | re.DOTALL) or re.fullmatch(r"([A-Za-z][\w-]*)\s*[:.)]\s*(.+)", text, re.ASCII | re.DOTALL)
    return (found[1], found[2].strip()) if found else (f"q{nth}", text)


def declarations(kind: str, text: str):
    """(line, warning, declaration or None) of each line of a policy file that says something; lines from 1."""
    nth = 0
    for number, line in enumerate(text.splitlines(), 1):
        plain = line.strip()
        if kind == "questions" and not re.match(r"(?:[-*]|[0-9]+\.)", plain):
            continue
        bare = re.sub(r"^-\s+" if kind == "ignore" else r"^(?:[-*]|[0-9]+\.)\s+" if kind == "questions" else r"^[-*]\s+", "", plain).strip()
        if not bare or bare.startswith("#"):
            continue
        nth += 1
        found = _declared(kind, bare, nth)
        if isinstance(found, str):
            yield number, found, None
        elif found is not None:
            yield number, None, found


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:")) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str, width: int):
        self.kind, self.path, self.width = kind, path, width

    def partitions(self):
        from pyarrow import fs

        system, at = _system(self.path)
        kind = system.get_file_info(at).type
        if kind == fs.FileType.File:
            return [_File(at)]
        found = system.get_file_info(fs.FileSelector(at, recursive=True)) if kind == fs.FileType.Directory else []
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name[0] not in "._"] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = _system(self.path)
        with system.open_input_stream(partition.path) as stream:
            text = stream.read().decode("utf-8", "replace")
        for line, warning, found in declarations(self.kind, text):
            yield (partition.path, line, warning, *(found or (None,) * self.width))


class PolicySource(DataSource):
    """The data source of this module; ``kind`` is an option, ``path`` what is loaded."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"file string, line int, warning string, {COLUMNS[self.options['kind']]}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["kind"], self.options["path"], len(schema) - 3)


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """All rows of a kind, mistakes included."""
    spark.dataSource.register(PolicySource)
    return spark.read.format(FORMAT).option("kind", kind).load(path)


def warnings(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """(file, line, warning) of what declares nothing."""
    return read(spark, kind, path).where("warning IS NOT NULL").select("file", "line", "warning")


def _only(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return read(spark, kind, path).where("warning IS NULL").drop("warning")


def _refuse(breaches: DataFrame, what: str) -> None:
    if row := breaches.first():
        raise ValueError(f"{what}: {', '.join(map(str, row))}")


def names(spark: SparkSession, path: str) -> DataFrame:
    return _only(spark, "names", path).select("name").distinct()


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(raw, canonical). A name mapped twice, to itself, or on from another mapping is an error."""
    _refuse(read(spark, "aliases", path).where("warning LIKE 'maps a name to itself%'").select("file", "line"), "a name mapped to itself")
    rows = _only(spark, "aliases", path).select("raw", "canonical").distinct()
    _refuse(rows.groupBy("raw").agg(F.count("*").alias("n")).where("n > 1").select("raw"), "mapped to several names")
    _refuse(rows.select(F.col("raw").alias("name")).join(rows.select(F.col("canonical").alias("name")), "name"), "both mapped and a target")
    return rows


def hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(relation, child, parent) as declared; ``graph.closed_hierarchy`` closes it."""
    return _only(spark, "hierarchy", path).select("relation", "child", "parent").distinct()


def types(spark: SparkSession, path: str) -> DataFrame:
    """(relation, type, alias, units), the last line of a relation counts. An alias of two relations is an error."""
    rows = _only(spark, "types", path)
    _refuse(rows.groupBy("alias").agg(F.countDistinct("relation").alias("n")).where("n > 1").select("alias"), "an alias of several relations")
    last = rows.groupBy("relation").agg(F.max_by(F.struct("type", "alias", "units"), F.struct("file", "line")).alias("x"))
    return last.select("relation", "x.*")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, members): groups as they are written, not merged."""
    return _only(spark, "synonyms", path)


def ignore_globs(spark: SparkSession, path: str) -> DataFrame:
    return _only(spark, "ignore", path).select("pattern").distinct()


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question); an id given twice is an error."""
    rows = _only(spark, "questions", path)
    _refuse(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "a question's id given twice")
    return rows.select("id", "question")
