"""The reader of assembly metadata, over files that are built here table by table as the format describes them."""

import struct

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans import packages
from loomgraph.sources import assemblies, symbols

TABLES = 45


class Builder:
    """A small portable executable with metadata; all indexes are narrow unless the string heap is padded."""

    def __init__(self, pad=0):
        self.strings, self.blobs, self.rows = bytearray(b"\0" + b"x" * pad + b"\0"), bytearray(b"\0"), {}

    def s(self, text):
        self.strings += text.encode() + b"\0"
        return len(self.strings) - len(text.encode()) - 1

    def b(self, *data):
        self.blobs += bytes([len(data), *data])
        return len(self.blobs) - len(data) - 1

    def add(self, table, columns, *values):
        """One row; columns in the letters of struct, S for a place in the string heap."""
        self.rows.setdefault(table, []).append((columns, values))
        return len(self.rows[table])

    def file(self, wide=False):
        heap = "I" if len(self.strings) >= 1 << 16 else "H"
        present = sorted(self.rows)
        tables = struct.pack("<IBBBBQQ", 0, 2, 0, 1 if heap == "I" else 0, 1, sum(1 << k for k in present), 0) + b"".join(struct.pack("<I", len(self.rows[k])) for k in present)
        tables += b"".join(struct.pack("<" + c.replace("S", heap), *v) for k in present for c, v in self.rows[k])
        streams = [(b"#~", tables), (b"#Strings", bytes(self.strings)), (b"#Blob", bytes(self.blobs))]
        streams = [(n, d + b"\0" * (-len(d) % 4)) for n, d in streams]
        version = b"v4.0.30319\0\0"
        head = struct.pack("<IHHII", 0x424A5342, 1, 1, 0, len(version)) + version + struct.pack("<HH", 0, len(streams))
        at = len(head) + sum(8 + (len(n) // 4 + 1) * 4 for n, _ in streams)
        for n, d in streams:
            head += struct.pack("<II", at, len(d)) + n + b"\0" * (4 - len(n) % 4)
            at += len(d)
        root = head + b"".join(d for _, d in streams)
        body = struct.pack("<IHHII", 72, 2, 5, 0x2000 + 72, len(root)) + b"\0" * 56 + root
        optional = struct.pack("<H", 0x20B if wide else 0x10B) + b"\0" * ((112 if wide else 96) - 2) + b"\0" * (14 * 8) + struct.pack("<II", 0x2000, 72) + b"\0" * 8
        section = b".text\0\0\0" + struct.pack("<IIII", len(body), 0x2000, len(body), 512) + b"\0" * 16
        pe = b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(optional), 0) + optional + section
        start = b"MZ" + b"\0" * 58 + struct.pack("<I", 64)
        return (start + pe).ljust(512, b"\0") + body


def kit(pad=0, wide=False):
    k = Builder(pad)
    s, b = k.s, k.b
    k.add(0x00, "HSHHH", 0, s("Kit.dll"), 0, 0, 0)
    for space, name in (("System", "Object"), ("System", "ValueType"), ("System", "Enum"), ("System", "MulticastDelegate"), ("System.Runtime.CompilerServices", "CompilerGeneratedAttribute"), ("System.Collections.Generic", "List`1")):
        k.add(0x01, "HSS", 1 << 2 | 2, s(name), s(space))
    k.add(0x01, "HSS", 6 << 2 | 3, s("Enumerator"), s(""))  # 7: nested in List`1
    ref, own = (lambda n: n << 2 | 1), (lambda n: n << 2)
    # flags, name, namespace, base, first method (1 to 7 belong to the second type, 8 to Deep`1)
    defined = [
        (0, "<Module>", "", 0, 1), (1, "Finder", "Kit", ref(1), 1), (2, "Inner", "", ref(2), 8), (0xA1, "IFind", "Kit", 0, 8), (1, "Colour", "Kit", ref(3), 8), (1, "Deep`1", "Kit", own(2), 8),
        (0, "Secret", "Kit", ref(1), 9), (2, "Shown", "", ref(1), 9), (1, "Made", "Kit", ref(1), 9), (1, "Handler", "Kit", ref(4), 9), (1, "Loose", "", ref(1), 9), (1, "Bag", "Kit", 1 << 2 | 2, 9), (0xA1, "IMore", "Kit", 0, 9),
    ]
    for flags, name, space, base, first in defined:
        k.add(0x02, "ISSHHH", flags, s(name), s(space), base, 1, first)
    found = [
        (0x1886, ".ctor", b(0x20, 0, 0x01), 1), (0x86, "Find", b(0x20, 1, 0x0E, 0x08), 1), (0x81, "Hidden", b(0x20, 0, 0x01), 2), (0x86, "Generated", b(0x20, 0, 0x01), 2),
        (0x96, "All", b(0x10, 1, 4, 0x02, 0x15, 0x12, ref(6), 1, 0x1E, 0, 0x10, 0x08, 0x1D, 0x0E, 0x14, 0x0D, 2, 0, 0), 2), (0x886, "get_X", b(0x20, 0, 0x08), 6),
        (0x86, "Broken", b(0x20, 1, 0x01, 0x3F), 6), (0x86, "Put", b(0x20, 3, 0x01, 0x13, 0, 0x11, own(3), 0x1F, ref(1), 0x15, 0x11, ref(7), 1, 0x0E), 6),
    ]
    for traits, name, signature, first in found:
        k.add(0x06, "IHHSHH", 0, 0, traits, s(name), signature, first)
    for place, name in ((1, "id"), (1, "items"), (2, "n"), (3, "names"), (4, "grid"), (1, "item"), (2, "inner")):
        k.add(0x08, "HHS", 0, place, s(name))
    for t, i in ((2, own(4)), (4, own(13)), (6, own(4)), (6, own(13)), (12, own(4))):
        k.add(0x09, "HH", t, i)
    k.add(0x0A, "HSH", 5 << 3 | 1, s(".ctor"), b(0x20, 0, 0x01))
    for owner in (4 << 5, 9 << 5 | 3):
        k.add(0x0C, "HHH", owner, 1 << 3 | 3, 0)
    k.add(0x1B, "H", b(0x15, 0x12, ref(6), 1, 0x0E))
    k.add(0x20, "IHHHHIHSS", 0, 1, 0, 0, 0, 0, 0, s("Kit"), 0)
    k.add(0x23, "HHHHIHSSH", 8, 0, 0, 0, 0, 0, s("System.Runtime"), 0, 0)
    for inner, outer in ((3, 2), (8, 7)):
        k.add(0x29, "HH", inner, outer)
    k.add(0x2A, "HHHS", 0, 0, 6 << 1, s("T"))
    k.add(0x2A, "HHHS", 0, 0, 5 << 1 | 1, s("U"))
    return k.file(wide)


def test_tables_are_all_there():
    assert len(assemblies.TABLES) == TABLES and assemblies.TABLES[0x2A] == "u2 u2 TypeOrMethodDef S" and assemblies.TABLES[0x20].startswith("u4 u2 u2 u2 u2 u4 B")
    names = {c for t in assemblies.TABLES for c in t.split()}
    assert {n for n in names if len(n) > 2} == set(assemblies.CODED)


@pytest.mark.parametrize(("pad", "wide"), [(0, False), (0, True), (70000, False)])
def test_types(pad, wide):
    name, found = assemblies.types(kit(pad, wide))
    assert name == "Kit"
    got = {(t["namespace"], t["type"]): t for t in found}
    assert {k: t["kind"] for k, t in got.items()} == {
        ("", "Loose"): "class", ("Kit", "Bag"): "class", ("Kit", "Colour"): "enum", ("Kit", "Deep`1"): "class", ("Kit", "Finder"): "class", ("Kit", "Finder.Inner"): "struct", ("Kit", "Handler"): "delegate", ("Kit", "IFind"): "interface",
        ("Kit", "IMore"): "interface",
    }
    finder, deep, bag = got["Kit", "Finder"], got["Kit", "Deep`1"], got["Kit", "Bag"]
    assert (finder["base"], finder["interfaces"], finder["inherited"]) == ("System.Object", ["Kit.IFind", "Kit.IMore"], [])
    assert (deep["base"], deep["interfaces"], deep["inherited"]) == ("Kit.Finder", ["Kit.IFind", "Kit.IMore"], ["Kit.IFind", "Kit.IMore"])
    assert bag["base"] == "System.Collections.Generic.List`1" and got["Kit", "IFind"]["base"] is None
    assert [m["shown"] for m in finder["methods"]] == [
        "string Kit.Finder.Find(int id)",
        "bool Kit.Finder.All(System.Collections.Generic.List<U> items, System.Int32& n, System.String[] names, System.Double[,] grid)",
    ]
    assert [m["signature"] for m in finder["methods"]] == ["Find(int)", "All(System.Collections.Generic.List<U>,System.Int32&,System.String[],System.Double[,])"]
    assert [m["shown"] for m in deep["methods"]] == ["void Kit.Deep`1.Put(T item, Kit.Finder.Inner inner, System.Collections.Generic.List<string> )"]


def test_from_files_to_a_graph(spark, tmp_path):
    for version, data in (("1.0.0", kit()), ("2.0.0", b"MZ no assembly"), ("3.0.0", b""), ("4.0.0", kit()[:900])):
        folder = tmp_path / "kit" / version / "lib" / "net8.0"
        folder.mkdir(parents=True)
        (folder / "Kit.dll").write_bytes(data)
    wanted = spark.createDataFrame([("Kit", f"{v}.0.0", f"{tmp_path}/kit/{v}.0.0/lib/net8.0/Kit.dll") for v in (1, 1, 2, 3, 4, 5)], "package string, version string, dll string")
    found = assemblies.read(spark, wanted, str(tmp_path))
    assert {(r["package"], r["version"], r["assembly"], r["n"]) for r in found.groupBy("package", "version", "assembly").agg(F.count(F.lit(1)).alias("n")).collect()} == {("Kit", "1.0.0", "Kit", 9)}
    g = symbols.graph(found)
    assert isinstance(g, PropertyGraph)
    relations = {(r["from_id"], r["to_id"], r["kind"]) for r in g.edges.where("kind in ('Inherits', 'Implements')").collect()}
    one = lambda k, n: f"{k}:Kit.{n}@1.0.0"
    assert relations >= {(one("Type", "Finder"), one("Type", "IFind"), "Implements"), (one("Type", "Finder.Inner"), "ExternalRef:System.ValueType@external", "Inherits")}
    assert not [r for r in relations if "Deep" in r[0] and r[2] == "Implements"]
    find = g.nodes.where("kind = 'Method' and display_name = 'Kit.Finder.Find(int)'").first()
    assert find["attributes"]["signature"] == '"string Kit.Finder.Find(int id)"'
    assert packages.version_conflicts(g).collect() == []


def test_nothing_to_read(spark):
    none = spark.createDataFrame([("Kit", "1.0.0", None), (None, None, bytearray(kit())), ("Odd", "1", bytearray(b"\0" * 64))], "package string, version string, content binary")
    assert {(r["package"], r["assembly"]) for r in assemblies.symbols(none).select("package", "assembly").distinct().collect()} == {(None, "Kit")}
    assert assemblies.symbols(none.limit(0)).collect() == []
