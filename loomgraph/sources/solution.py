"""Solutions, projects and their resolved packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import package_identity


def projects(files: DataFrame) -> DataFrame:
    """(file, project_path) of the projects that .slnx (XML) and .sln (text) solutions list. files: file, text."""
    xml = files.where(F.lower("file").endswith(".slnx")).select("file", F.explode(F.xpath("text", F.lit("//Project/@Path"))).alias("project_path"))
    rows = files.where(F.lower("file").endswith(".sln")).select("file", F.explode(F.split("text", "\r?\n")).alias("line")).where(F.ltrim("line").startswith("Project("))
    text = rows.select("file", F.regexp_replace(F.trim(F.get(F.split("line", ","), F.lit(1))), '"', "").alias("project_path"))
    paths = xml.unionByName(text).select("file", F.replace("project_path", F.lit("\\"), F.lit("/")).alias("project_path"))
    return paths.where(F.lower("project_path").endswith(".csproj")).distinct()


_ASSETS = """struct<targets:map<string,map<string,struct<type:string>>>, libraries:map<string,struct<type:string,path:string,files:array<string>>>,
project:struct<frameworks:map<string,struct<dependencies:map<string,struct<target:string,version:string>>>>>, packageFolders:map<string,string>>"""


def dependencies(assets: DataFrame) -> DataFrame:
    """(project, package, version, tfm, is_direct, path) of project.assets.json files, given as (project, text): each package of a target
    that the libraries have too; direct if the project's framework of that target names it."""
    parsed = assets.select("project", F.from_json("text", _ASSETS).alias("a"))
    targets = parsed.select("project", F.explode("a.targets").alias("tfm", "members")).select("project", "tfm", F.explode("members").alias("id", "m"))
    libraries = parsed.select("project", F.explode("a.libraries").alias("id", "l")).where("l.type = 'package'").select("project", "id", "l.path")
    direct = (
        parsed.select("project", F.explode("a.project.frameworks").alias("tfm", "f")).select("project", "tfm", F.explode("f.dependencies").alias("package", "d")).select("project", "tfm", F.lower("package").alias("name"), F.lit(True).alias("direct")).distinct()
    )
    rows = targets.join(libraries, ["project", "id"]).select("project", "tfm", "path", package_identity(F.col("id")).alias("p")).select("project", "tfm", "path", F.col("p.name").alias("package"), F.col("p.version").alias("version"))
    named = rows.withColumn("name", F.lower("package")).join(direct, ["project", "tfm", "name"], "left")
    return named.select("project", "package", "version", "tfm", F.coalesce("direct", F.lit(False)).alias("is_direct"), "path")


def assemblies(assets: DataFrame) -> DataFrame:
    """(project, package, version, dll): the library files that each package brings, below each package folder."""
    parsed = assets.select("project", F.from_json("text", _ASSETS).alias("a"))
    library = parsed.select("project", F.map_keys("a.packageFolders").alias("folders"), F.explode("a.libraries").alias("id", "l")).where("l.type = 'package'")
    files = library.select("project", "folders", "id", "l.path", F.explode("l.files").alias("f")).where(F.lower("f").rlike(r"^lib/.*\.dll$"))
    p = package_identity(F.col("id"))
    return files.select("project", p["name"].alias("package"), p["version"].alias("version"), F.explode("folders").alias("folder"), "path", "f").select(
        "project", "package", "version", F.concat(F.regexp_replace("folder", "/+$", ""), F.lit("/"), F.col("path"), F.lit("/"), F.col("f")).alias("dll")
    )
