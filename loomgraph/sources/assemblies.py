"""Exported types and methods of .NET assemblies, read from their metadata (ECMA-335, partition II) in Python workers.

No type of another assembly is loaded, so a generic instance that is a base or an interface goes by the name of its definition, and what comes with a base is
known only as far as the bases lie in the same assembly. Files without readable metadata, and assemblies without an exported type, give no row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The result: symbols.SYMBOLS_DDL, and each method as it is shown.
TYPES_DDL = "package string, version string, assembly string, namespace string, type string, kind string, base string, interfaces array<string>, inherited array<string>, methods array<struct<name:string,signature:string,shown:string>>"

# The columns of the metadata tables (II.22), by number from 0. u2 and u4 are numbers, S, G and B places in the heaps of strings, GUIDs and blobs,
# two hexadecimal digits a row of that table, other names one of several tables.
TABLES = """
u2 S G G G|ResolutionScope S S|u4 S S TypeDefOrRef 04 06|04|u2 S B|06|u4 u2 u2 S B 08|08|u2 u2 S|02 TypeDefOrRef|MemberRefParent S B|u2 HasConstant B
HasCustomAttribute CustomAttributeType B|HasFieldMarshal B|u2 HasDeclSecurity B|u2 u4 02|u4 04|B|02 14|14|u2 S TypeDefOrRef|02 17|17|u2 S B
u2 06 HasSemantics|02 MethodDefOrRef MethodDefOrRef|S|B|u2 MemberForwarded S 1A|u4 04|u4 u4|u4|u4 u2 u2 u2 u2 u4 B S S|u4|u4 u4 u4|u2 u2 u2 u2 u4 B S S B
u4 23|u4 u4 u4 23|u4 S B|u4 u4 S S Implementation|u4 u4 S Implementation|02 02|u2 u2 TypeOrMethodDef S|MethodDefOrRef B|2A TypeDefOrRef
""".strip().replace("\n", "|").split("|")
# Which tables a coded index can name (II.24.2.6), in the order of its tag; -- is none.
CODED = {
    "TypeDefOrRef": "02 01 1B", "HasConstant": "04 08 17", "HasCustomAttribute": "06 04 01 02 08 09 0A 00 0E 17 14 11 1A 1B 20 23 26 27 28 2A 2C 2B", "HasFieldMarshal": "04 08",
    "HasDeclSecurity": "02 06 20", "MemberRefParent": "02 01 1A 06 1B", "HasSemantics": "14 17", "MethodDefOrRef": "06 0A", "MemberForwarded": "04 06", "Implementation": "26 23 27",
    "CustomAttributeType": "-- -- 06 0A --", "ResolutionScope": "00 1A 23 01", "TypeOrMethodDef": "02 06",
}
# Element types of signatures (II.23.1.16) that are a type by themselves.
PLAIN = {
    0x01: "System.Void", 0x02: "System.Boolean", 0x03: "System.Char", 0x04: "System.SByte", 0x05: "System.Byte", 0x06: "System.Int16", 0x07: "System.UInt16", 0x08: "System.Int32", 0x09: "System.UInt32",
    0x0A: "System.Int64", 0x0B: "System.UInt64", 0x0C: "System.Single", 0x0D: "System.Double", 0x0E: "System.String", 0x16: "System.TypedReference", 0x18: "System.IntPtr", 0x19: "System.UIntPtr", 0x1C: "System.Object",
}
# Names that are shown for some types; the mark of generated code.
SHOWN = {"System.Void": "void", "System.String": "string", "System.Int32": "int", "System.Boolean": "bool"}
GENERATED = "System.Runtime.CompilerServices.CompilerGeneratedAttribute"

TYPE_REF, TYPE_DEF, METHOD, PARAM, INTERFACE, MEMBER_REF, ATTRIBUTE, TYPE_SPEC, ASSEMBLY, NESTED, GENERIC_PARAM = 0x01, 0x02, 0x06, 0x08, 0x09, 0x0A, 0x0C, 0x1B, 0x20, 0x29, 0x2A


def _bits(coded: str) -> int:
    return (len(CODED[coded].split()) - 1).bit_length()


class Metadata:
    """The tables of one file. Rows count from 1 as in the format."""

    def __init__(self, data: bytes) -> None:
        root = self._root(data)
        if data[root : root + 4] != b"BSJB":
            raise ValueError("no metadata")
        (named,) = struct.unpack_from("<I", data, root + 12)
        at = root + 16 + named
        (streams,) = struct.unpack_from("<H", data, at + 2)
        at += 4
        heaps: dict[bytes, bytes] = {}
        for _ in range(streams):
            start, size = struct.unpack_from("<II", data, at)
            name = data[at + 8 : data.index(b"\0", at + 8)]
            heaps[name] = data[root + start : root + start + size]
            at += 8 + (len(name) // 4 + 1) * 4
        self.strings, self.blobs = heaps.get(b"#Strings", b""), heaps.get(b"#Blob", b"")
        self._tables(heaps[b"#~"])

    @staticmethod
    def _root(data: bytes) -> int:
        """Where the metadata begins in the file."""
        (pe,) = struct.unpack_from("<I", data, 0x3C)
        if data[:2] != b"MZ" or data[pe : pe + 4] != b"PE\0\0":
            raise ValueError("no portable executable")
        sections, optional = struct.unpack_from("<H", data, pe + 6)[0], struct.unpack_from("<H", data, pe + 20)[0]
        wide = struct.unpack_from("<H", data, pe + 24)[0] == 0x20B
        table = pe + 24 + optional

        def offset(rva: int) -> int:
            for k in range(sections):
                virtual_size, virtual, raw_size, raw = struct.unpack_from("<IIII", data, table + 40 * k + 8)
                if virtual <= rva < virtual + max(virtual_size, raw_size):
                    return rva - virtual + raw
            raise ValueError("outside all sections")

        (header,) = struct.unpack_from("<I", data, pe + 24 + (112 if wide else 96) + 14 * 8)
        return offset(struct.unpack_from("<I", data, offset(header) + 8)[0])

    def _tables(self, data: bytes) -> None:
        wide_heaps = data[6]
        (valid,) = struct.unpack_from("<Q", data, 8)
        present = [k for k in range(64) if valid >> k & 1]
        if present and present[-1] >= len(TABLES):
            raise ValueError("tables of another format")
        rows = dict(zip(present, struct.unpack_from(f"<{len(present)}I", data, 24), strict=True))
        at = 24 + 4 * len(present) + (4 if wide_heaps & 0x40 else 0)

        def width(column: str) -> str:
            if column in ("u2", "u4"):
                return "<" + column
            if column in ("S", "G", "B"):
                return "<u4" if wide_heaps >> "SGB".index(column) & 1 else "<u2"
            if column in CODED:
                most = max(rows.get(int(t, 16), 0) for t in CODED[column].split() if t != "--")
                return "<u4" if most >= 1 << (16 - _bits(column)) else "<u2"
            return "<u4" if rows.get(int(column, 16), 0) >= 1 << 16 else "<u2"

        self.table: dict[int, list[list[int]]] = {}
        for k in present:
            kind = np.dtype([(f"c{i}", width(c)) for i, c in enumerate(TABLES[k].split())])
            found = np.frombuffer(data, kind, rows[k], at)
            self.table[k] = [found[c].tolist() for c in kind.names]
            at += kind.itemsize * rows[k]

    def rows(self, table: int) -> Iterator[tuple]:
        return zip(*self.table.get(table, []), strict=True)

    def cell(self, table: int, row: int, column: int) -> int:
        return self.table[table][column][row - 1]

    def string(self, at: int) -> str:
        return self.strings[at : self.strings.index(b"\0", at)].decode("utf-8")

    def blob(self, at: int) -> bytes:
        size, at = number(self.blobs, at)
        return self.blobs[at : at + size]

    def members(self, table: int, column: int, of: int) -> list[range]:
        """For each row of a table the rows of another that are its own: from the one it names up to where the next row's begin."""
        first = self.table[table][column] if table in self.table else []
        end = len(self.table[of][0]) + 1 if of in self.table else 1
        return [range(a, min(b, end)) for a, b in zip(first, [*first[1:], end], strict=True)]

    @cached_property
    def outer(self) -> dict[int, int]:
        return dict(self.rows(NESTED))

    def defined(self, row: int) -> str:
        """Full name of a type of this file, nested ones behind a plus."""
        name = self.string(self.cell(TYPE_DEF, row, 1))
        if row in self.outer:
            return f"{self.defined(self.outer[row])}+{name}"
        space = self.string(self.cell(TYPE_DEF, row, 2))
        return f"{space}.{name}" if space else name

    def referred(self, row: int) -> str:
        """Full name of a type of another file."""
        scope, name = self.cell(TYPE_REF, row, 0), self.string(self.cell(TYPE_REF, row, 1))
        if scope & 3 == 3:
            return f"{self.referred(scope >> 2)}+{name}"
        space = self.string(self.cell(TYPE_REF, row, 2))
        return f"{space}.{name}" if space else name

    def type_name(self, coded: int) -> str:
        """Full name of a TypeDefOrRef index; of a generic instance that of its definition."""
        row = coded >> 2
        if coded & 3 == 0:
            return self.defined(row)
        if coded & 3 == 1:
            return self.referred(row)
        return Signature(self, self.blob(self.cell(TYPE_SPEC, row, 0)), [], []).type()[0]

    @cached_property
    def generics(self) -> dict[int, list[str]]:
        """Names of the generic parameters of each TypeOrMethodDef index."""
        found: dict[int, list[tuple[int, str]]] = {}
        for place, _, owner, name in self.rows(GENERIC_PARAM):
            found.setdefault(owner, []).append((place, self.string(name)))
        return {owner: [n for _, n in sorted(names)] for owner, names in found.items()}

    @cached_property
    def generated(self) -> set[int]:
        """HasCustomAttribute indexes of what is marked as generated."""
        owner_of = {m: t for t, ms in enumerate(self.members(TYPE_DEF, 5, METHOD), 1) for m in ms}
        out = set()
        for owner, made_by, _ in self.rows(ATTRIBUTE):
            row = made_by >> 3
            if made_by & 7 == 3:
                parent = self.cell(MEMBER_REF, row, 0)
                name = self.defined(parent >> 3) if parent & 7 == 0 else self.referred(parent >> 3) if parent & 7 == 1 else ""
            else:
                name = self.defined(owner_of[row]) if row in owner_of else ""
            if name == GENERATED:
                out.add(owner)
        return out


def number(data: bytes, at: int) -> tuple[int, int]:
    """A compressed number (II.23.2) and the place behind it."""
    first = data[at]
    if first < 0x80:
        return first, at + 1
    if first < 0xC0:
        return (first & 0x3F) << 8 | data[at + 1], at + 2
    return (first & 0x1F) << 24 | data[at + 1] << 16 | data[at + 2] << 8 | data[at + 3], at + 4


class Signature:
    """Reads types from a signature. Each is a pair: its full name, and how it is shown."""

    def __init__(self, meta: Metadata, data: bytes, of_type: list[str], of_method: list[str]) -> None:
        self.meta, self.data, self.at, self.of_type, self.of_method = meta, data, 0, of_type, of_method

    def next(self) -> int:
        value, self.at = number(self.data, self.at)
        return value

    def named(self) -> str:
        return self.meta.type_name(self.next())

    def type(self) -> tuple[str, str]:
        kind = self.next()
        if kind in PLAIN:
            return PLAIN[kind], SHOWN.get(PLAIN[kind], PLAIN[kind])
        if kind in (0x11, 0x12):  # a value type or class by its index
            name = self.named()
            return name, name.replace("+", ".")
        if kind in (0x13, 0x1E):  # a generic parameter of the type or the method
            names, k = (self.of_type if kind == 0x13 else self.of_method), self.next()
            name = names[k] if k < len(names) else f"{'!' * (1 if kind == 0x13 else 2)}{k}"
            return name, name
        if kind == 0x15:  # a generic instance
            self.next()
            name = self.named()
            arguments = [self.type()[1] for _ in range(self.next())]
            return name, f"{name.split('`')[0]}<{', '.join(arguments)}>"
        if kind in (0x1F, 0x20):  # a modifier before the type
            self.next()
            return self.type()
        if kind in (0x41, 0x45):  # a sentinel, or a pin
            return self.type()
        if kind in (0x0F, 0x10, 0x1D):  # a pointer, a reference, a vector
            name = self.type()[0].replace("+", ".") + {0x0F: "*", 0x10: "&", 0x1D: "[]"}[kind]
            return name, name
        if kind == 0x14:  # an array with its shape
            name, rank = self.type()[0].replace("+", "."), self.next()
            for _ in range(2):
                for _ in range(self.next()):
                    self.next()
            name += f"[{',' * (rank - 1) or '*'}]"
            return name, name
        if kind == 0x1B:  # a pointer to a function
            self.method()
            return "System.IntPtr", "System.IntPtr"
        raise ValueError(f"element type {kind}")

    def method(self) -> tuple[str, list[str]]:
        """How the result and the parameters are shown."""
        convention = self.next()
        if convention & 0x10:
            self.next()
        count = self.next()
        result = self.type()[1]
        return result, [self.type()[1] for _ in range(count)]


def types(data: bytes) -> tuple[str, list[dict]]:
    """The name of an assembly and its exported types by name: namespace, type, kind, base, interfaces, inherited, methods. Types and methods marked as generated,
    and methods of a special name, are left out; a method whose signature can't be read too. Raises ValueError, IndexError, KeyError or struct.error for other files."""
    meta = Metadata(data)
    assembly = meta.string(meta.cell(ASSEMBLY, 1, 7))
    flags, _, _, extends, _, _ = meta.table[TYPE_DEF]
    count = len(flags)
    methods = meta.members(TYPE_DEF, 5, METHOD)
    parameters = meta.members(METHOD, 5, PARAM) if METHOD in meta.table else []
    own: dict[int, list[int]] = {}
    for t, i in meta.rows(INTERFACE):
        own.setdefault(t, []).append(i)

    def visible(row: int) -> bool:
        access = flags[row - 1] & 7
        return access == 1 if row not in meta.outer else access == 2 and visible(meta.outer[row])

    def all_interfaces(row: int) -> set[str]:
        """Interfaces of a type, of its bases and of those interfaces, as far as this file knows."""
        found, todo, seen = set(), [row], set()
        while todo:
            r = todo.pop()
            if r in seen:
                continue
            seen.add(r)
            base = extends[r - 1]
            todo += [base >> 2] if base and base & 3 == 0 else []
            for i in own.get(r, ()):
                found.add(meta.type_name(i).replace("+", "."))
                todo += [i >> 2] if i & 3 == 0 else []
        return found

    def described(row: int, name: str) -> list[dict]:
        out = []
        for m in methods[row - 1]:
            _, _, traits, label, signature, _ = (c[m - 1] for c in meta.table[METHOD])
            if traits & 7 != 6 or traits & 0x0800 or m << 5 in meta.generated:
                continue
            try:
                result, kinds = Signature(meta, meta.blob(signature), meta.generics.get(row << 1, []), meta.generics.get(m << 1 | 1, [])).method()
            except (ValueError, IndexError, KeyError):
                continue
            places = {meta.cell(PARAM, p, 1): meta.string(meta.cell(PARAM, p, 2)) for p in parameters[m - 1]}
            shown = ", ".join(f"{k} {places.get(i, '')}" for i, k in enumerate(kinds, 1))
            called = meta.string(label)
            out.append({"name": called, "signature": f"{called}({','.join(kinds)})", "shown": f"{result} {name}.{called}({shown})"})
        return out

    found = []
    for row in range(1, count + 1):
        if not visible(row) or row << 5 | 3 in meta.generated:
            continue
        name = meta.defined(row).replace("+", ".")
        top = row
        while top in meta.outer:
            top = meta.outer[top]
        space = meta.string(meta.cell(TYPE_DEF, top, 2))
        base = meta.type_name(extends[row - 1]).replace("+", ".") if extends[row - 1] else None
        kind = "interface" if flags[row - 1] & 0x20 else {"System.Enum": "enum", "System.MulticastDelegate": "delegate", "System.ValueType": "struct"}.get(base or "", "class")
        above = extends[row - 1]
        inherited = all_interfaces(above >> 2) if above and above & 3 == 0 else set()
        found.append(
            {"namespace": space, "type": name[len(space) + 1 :] if space else name, "kind": kind, "base": base, "interfaces": sorted(all_interfaces(row)), "inherited": sorted(inherited), "methods": described(row, name)}
        )
    return assembly, sorted(found, key=lambda t: (t["namespace"], t["type"]))


def symbols(packages: DataFrame) -> DataFrame:
    """TYPES_DDL rows of (package, version, content), the bytes of an assembly; null or other bytes give none."""
    names = [c.split()[0] for c in TYPES_DDL.split(", ")]
    text = pa.string()
    schema = pa.schema([(n, {"interfaces": pa.list_(text), "inherited": pa.list_(text), "methods": pa.list_(pa.struct([("name", text), ("signature", text), ("shown", text)]))}.get(n, text)) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one file at a time is in memory as objects
                package, version, content = (b.column(k)[i].as_py() for k in range(3))
                try:
                    assembly, found = types(content or b"")
                except (ValueError, IndexError, KeyError, RecursionError, struct.error):
                    continue
                if found:
                    yield pa.RecordBatch.from_pylist([{"package": package, "version": version, "assembly": assembly, **t} for t in found], schema=schema)

    return packages.select("package", "version", "content").mapInArrow(run, TYPES_DDL)


def read(spark: SparkSession, wanted: DataFrame, root: str) -> DataFrame:
    """TYPES_DDL rows of the wanted (package, version, dll), as solution.assemblies() gives them, from the files below a folder of packages."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), "^/+", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[dD][lL][lL]").load(root).select(bare(F.col("path")).alias("dll"), "content")
    return symbols(wanted.select("package", "version", bare(F.col("dll")).alias("dll")).distinct().join(files, "dll"))
