"""JSON paths: cut into segments, read and write values, subtree tests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A path segment is .name, [index] or ['key'].
SEGMENT = r"\.([A-Za-z_][A-Za-z0-9_]*)|\[(\d+)\]|\['((?:[^'\\]|\\.)*)'\]"


def segments(path: Column) -> Column:
    """All segments of a path, without their marks, outermost first."""
    marked = F.regexp_extract_all(path, F.lit(SEGMENT), F.lit(0))
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"^\.|^\['?|'?\]$", ""), r"\\(.)", "$1")
    return F.transform(marked, bare)


def parent(path: Column) -> Column:
    """The path without its last segment; '$' has none."""
    last = rf"(?:{SEGMENT})$"
    return F.when(path == "$", F.lit(None).cast("string")).otherwise(F.regexp_replace(path, last, ""))


def within(path: Column, root: str) -> Column:
    """Whether a path is ``root`` or below it; what follows '|' names a decorator and doesn't count."""
    plain = F.split_part(path, F.lit("|"), F.lit(1))
    return (plain == root) | plain.startswith(root + ".") | plain.startswith(root + "[")


def parse(path: str) -> list[str | int]:
    """Segments of a literal path."""
    out: list[str | int] = []
    at = 1 if path.startswith("$") else 0
    while at < len(path):
        m = re.compile(SEGMENT).match(path, at)
        if not m:
            raise ValueError(f"no segment at {at} in {path!r}")
        out.append(int(m[2]) if m[2] is not None else m[1] if m[1] is not None else re.sub(r"\\(.)", r"\1", m[3]))
        at = m.end()
    return out


def value_at(root: Column, path: str) -> Column:
    """The value at a literal path of a struct, map or array column; null where it doesn't resolve."""
    for s in parse(path):
        root = F.get(root, s) if isinstance(s, int) else root[s]
    return root


def with_value(root: Column, path: str, value: Column, kind: T.DataType | None = None, create: bool = False) -> Column:
    """A column with the value at a literal path replaced, in structs, arrays and maps. Without ``kind``, the type of
    ``root``, names are fields of structs and ['keys'] entries of maps of text; with it, keys are converted to the map's
    type, and names find entries too. A map gains an entry that it lacks; an array's index that it lacks changes nothing.
    Missing parents stay null, or, with ``create`` and ``kind``, are made with null fields."""
    marks = [m.group(0) for m in re.finditer(SEGMENT, path.removeprefix("$"))]
    parse(path)  # complains about what isn't a path
    return _with(root, marks, value, kind, create)


def _with(root: Column, marks: list[str], value: Column, kind: T.DataType | None, create: bool) -> Column:
    if not marks:
        return value
    mark, rest = marks[0], marks[1:]
    (name,) = parse("$" + mark)
    if isinstance(kind, T.MapType) or (kind is None and mark.startswith("['")):
        key = F.lit(name) if kind is None else F.lit(str(name)).cast(kind.keyType)
        new = _with(F.try_element_at(root, key), rest, value, kind.valueType if kind else None, create)
        entry = F.create_map(key, new)
        changed = F.map_concat(F.map_filter(root, lambda k, _: k != key), entry)
        return F.when(root.isNotNull(), changed).otherwise(entry if create else F.lit(None))
    if isinstance(kind, T.ArrayType) or (kind is None and isinstance(name, int)):
        return F.transform(root, lambda x, i: F.when(i == int(name), _with(x, rest, value, kind.elementType if kind else None, create)).otherwise(x))
    field = next((f for f in kind.fields if f.name.lower() == str(name).lower()), None) if isinstance(kind, T.StructType) else None
    if kind is not None and field is None:
        raise ValueError(f"no field {name} in {kind.simpleString()}")
    named = field.name if field else str(name)
    below = _with(root[named], rest, value, field.dataType if field else None, create)
    if create and field:
        empty = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields))
        return F.coalesce(root, empty).withField(named, below)
    return root.withField(named, below)


def coerced(value: Column, kind: str) -> Column:
    """Invariant conversion to a type; null where the text doesn't convert."""
    return value.try_cast(kind)
