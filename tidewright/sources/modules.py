"""Modules of source repositories: coordinates from their manifests, with what they inherit, and the folders that hold their sources.

Manifests of both build tools are tables of text; inheritance is followed by doubling, properties are put in until nothing changes, and a coordinate that several modules
claim, or that none has, is listed as such instead of being guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.core import cut, forget

# Where the sources of a module are by custom, the best first, and folders that hold none.
SOURCE_FOLDERS = ("src/main/java", "src/main/kotlin", "src/java", "java/src", "src")
_SKIPPED = r"(^|/)(\.git|target|build|\.gradle|out|bin|\.idea|\.upgrade-report)/"
_PROPERTY = r"\$\{([^{}]*)\}"


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _normal(path: Column) -> Column:
    """A path without . and .. parts."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin(".", ""))
    kept = F.reduce(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(F.array_append(a, p), -2) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.array_append(a, p)))
    return F.concat(F.when(F.substring(path, 1, 1) == "/", "/").otherwise(""), F.array_join(kept, "/"))


def poms(files: DataFrame) -> DataFrame:
    """``folder, group_id, artifact, version, parent_folder, parent_key, properties`` as the pom.xml files of ``path, text`` state them; null is what they don't.

    A file with a document type isn't read. Only what stands directly in the project counts, not what dependencies, plugins or profiles say.
    """
    f = files.where(F.col("path").rlike(r"(^|/)pom\.xml$") & ~F.col("path").rlike(_SKIPPED) & ~F.col("text").rlike("<!DOCTYPE"))
    clean = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(clean, r"(?s)<(dependencies|dependencyManagement|build|profiles|plugins|repositories|pluginRepositories|reporting|modules|licenses|developers|scm|distributionManagement)(\s[^>]*)?>.*?</\1>", "")
    f = f.select("path", bare.alias("text")).where(F.col("text").rlike(r"<project\b"))
    parent = F.regexp_extract("text", r"(?s)<parent>(.*?)</parent>", 1)
    own = F.regexp_replace("text", r"(?s)<parent>.*?</parent>|<properties>.*?</properties>", "")
    tag = lambda of, name: F.nullif(F.trim(F.regexp_extract(of, rf"<{name}>\s*([^<]*?)\s*</{name}>", 1)), F.lit(""))
    listed = F.regexp_extract("text", r"(?s)<properties>(.*?)</properties>", 1)
    names, values = (F.regexp_extract_all(listed, F.lit(r"<([\w.-]+)>([^<]*)</\1>"), F.lit(k)) for k in (1, 2))
    pairs = F.reduce(F.arrays_zip(names.alias("n"), values.alias("v")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: _put(m, p["n"], F.trim(p["v"])))
    relative = F.when(F.col("text").rlike(r"<relativePath\s*/>|<relativePath>\s*</relativePath>"), None).otherwise(F.coalesce(tag(parent, "relativePath"), F.lit("../pom.xml")))
    folder = folder_of(F.col("path"))
    above = F.when((parent != "") & relative.isNotNull(), _normal(F.concat(folder, F.lit("/"), F.regexp_replace(relative, r"/?pom\.xml$", ""))))
    return f.select(
        folder.alias("folder"), tag(own, "groupId").alias("group_id"), tag(own, "artifactId").alias("artifact"), tag(own, "version").alias("version"), above.alias("parent_folder"),
        F.when(parent != "", F.concat_ws(":", tag(parent, "groupId"), tag(parent, "artifactId"))).alias("parent_key"), tag(parent, "groupId").alias("parent_group"), tag(parent, "version").alias("parent_version"), pairs.alias("properties"),
    )


def _put(m: Column, name: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != name), F.create_map(name, value))


def inherited(found: DataFrame) -> DataFrame:
    """``folder, group_id, artifact, version, properties`` of poms with all that they inherit from parents in the repository, and with properties put in.

    The parent is the pom at the stated place if it has the stated name, else the only one in the repository with that name. A cycle of parents, or a property that
    nothing defines, leaves the text as it is.
    """
    p = found.withColumn("group_id", F.coalesce("group_id", "parent_group")).withColumn("version", F.coalesce("version", "parent_version"))
    named = p.select(F.col("folder").alias("_at"), F.concat_ws(":", "group_id", "artifact").alias("_key"))
    stated = p.where("parent_folder IS NOT NULL").join(named, (F.col("parent_folder") == F.col("_at")) & (F.col("parent_key") == F.col("_key"))).select("folder", F.col("_at").alias("parent"), F.lit(0).alias("_r"))
    only = named.groupBy("_key").agg(F.min("_at").alias("parent"), F.count("*").alias("_n")).where("_n = 1")
    other = p.join(only, F.col("parent_key") == F.col("_key")).select("folder", "parent", F.lit(1).alias("_r"))
    link = stated.unionByName(other).groupBy("folder").agg(F.min_by("parent", "_r").alias("parent"))
    now = cut(p.select("folder", "group_id", "artifact", "version", "properties").join(link, "folder", "left"))
    open_ = now.where("parent IS NOT NULL").count()
    while open_:
        above = now.select(F.col("folder").alias("parent"), F.col("group_id").alias("_g"), F.col("version").alias("_v"), F.col("properties").alias("_p"), F.col("parent").alias("_next"))
        merged = F.when(F.col("_p").isNull(), F.col("properties")).otherwise(F.map_concat(F.map_filter("_p", lambda k, _: ~F.map_contains_key("properties", k)), F.col("properties")))
        new = cut(now.join(above, "parent", "left").select("folder", F.coalesce("group_id", "_g").alias("group_id"), "artifact", F.coalesce("version", "_v").alias("version"), merged.alias("properties"), F.col("_next").alias("parent")))
        forget(now)
        now, before, open_ = new, open_, new.where("parent IS NOT NULL").count()
        if open_ == before:  # only cycles are left
            break
    whole = now.withColumn("properties", F.map_concat(F.map_filter("properties", lambda k, _: ~k.isin("project.groupId", "project.version", "project.artifactId")), F.create_map(F.lit("project.groupId"), F.coalesce("group_id", F.lit("")), F.lit("project.version"), F.coalesce("version", F.lit("")), F.lit("project.artifactId"), F.coalesce("artifact", F.lit("")))))

    def put(c: str) -> Column:
        name = F.regexp_extract(c, _PROPERTY, 1)
        value = F.get(F.map_values(F.map_filter("properties", lambda k, _: k == name)), F.lit(0))
        return F.when(F.coalesce(value, F.lit("")) == "", F.col(c)).otherwise(F.replace(F.col(c), F.concat(F.lit("${"), name, F.lit("}")), value))

    texts = ["group_id", "artifact", "version"]
    now = cut(whole)
    for _ in range(32):  # a property that goes round in a circle never ends; longer chains than this are left as they are
        new = cut(now.withColumns({c: put(c) for c in texts}))
        done = now.select("folder", *texts).exceptAll(new.select("folder", *texts)).isEmpty()
        forget(now)
        now = new
        if done:
            break
    return now.select("folder", *texts, "properties")


def gradle_modules(files: DataFrame) -> DataFrame:
    """``folder, group_id, artifact, version`` of folders with a build.gradle or build.gradle.kts, from ``path, text``: the group is the nearest one stated there or above."""
    f = files.where(~F.col("path").rlike(_SKIPPED) & F.col("path").rlike(r"(^|/)(build\.gradle(\.kts)?|gradle\.properties|settings\.gradle(\.kts)?)$"))
    plain = F.regexp_replace("text", r"(?s)/\*.*?\*/|//[^\n]*", "")
    stated = lambda name: F.nullif(F.regexp_extract(plain, rf"(?m)^\s*{name}\s*=?\s*[\"']?([\w.\-]+)[\"']?\s*$", 1), F.lit(""))
    said = f.select(folder_of(F.col("path")).alias("folder"), stated("group").alias("group_id"), stated("version").alias("version"), stated(r"rootProject\.name").alias("name"), F.col("path").rlike(r"build\.gradle(\.kts)?$").alias("build"))
    one = said.groupBy("folder").agg(F.min("group_id").alias("group_id"), F.min("version").alias("version"), F.min("name").alias("name"), F.bool_or("build").alias("build"))
    parts = F.split("folder", "/")
    above = one.where("build").select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts")).select("folder", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("at"), "depth")
    near = above.join(one.select(F.col("folder").alias("at"), "group_id", "version"), "at").groupBy("folder").agg(F.max_by("group_id", F.when(F.col("group_id").isNotNull(), F.col("depth"))).alias("group_id"), F.max_by("version", F.when(F.col("version").isNotNull(), F.col("depth"))).alias("version"))
    own = one.where("build").select("folder", F.coalesce("name", F.element_at(parts, -1)).alias("artifact"))
    return own.join(near, "folder").where("group_id IS NOT NULL AND artifact != ''").select("folder", "group_id", "artifact", "version")


def source_folders(modules: DataFrame, sources: DataFrame) -> DataFrame:
    """``folder, source_folder`` of modules (folder): the customary folders that hold a file whose package fits its place; else the one where most do, if no module lies below.

    ``sources``: path, text of Java and Kotlin files. A file belongs to the module whose folder is the longest before its path.
    """
    s = sources.where(F.col("path").rlike(r"\.(java|kt)$") & ~F.col("path").rlike(_SKIPPED))
    package = F.regexp_extract(F.regexp_replace("text", r"(?s)/\*.*?\*/", ""), r"(?m)^\s*package\s+([\w.]+)", 1)
    place = folder_of(F.col("path"))
    fits = F.endswith(F.concat(F.lit("/"), place), F.concat(F.lit("/"), F.translate(package, ".", "/")))
    s = s.select("path", place.alias("place"), package.alias("package")).where((F.col("package") != "") & fits)
    s = s.withColumn("root", F.regexp_replace(F.expr("substring(place, 1, length(place) - length(package))"), "/$", ""))
    m = modules.select("folder").distinct()
    parts = F.split("root", "/")
    roots = s.groupBy("root").agg(F.count("*").alias("files"))
    over = roots.select("root", "files", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts")).select("root", "files", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("folder"))
    owned = over.join(m, "folder").groupBy("root").agg(F.max_by("folder", "depth").alias("folder"), F.first("files").alias("files"))
    below = F.when(F.col("folder") == "", F.col("root")).otherwise(F.expr("substring(root, length(folder) + 2)"))
    usual = owned.where(below.isin(*SOURCE_FOLDERS)).select("folder", F.col("root").alias("source_folder"))
    step = F.split("folder", "/")
    parents = m.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(step) - 1), lambda n: F.array_join(F.slice(step, F.lit(1), n), "/"))).alias("folder")).distinct()
    most = owned.join(usual.select("folder").distinct(), "folder", "left_anti").join(parents, "folder", "left_anti")
    best = most.groupBy("folder").agg(F.min_by("root", F.struct(-F.col("files"), "root")).alias("source_folder"))
    return usual.unionByName(best)


def discovered(modules: DataFrame, sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted, coord, source_folder, status`` of coordinates (group:artifact, or a group alone) that sources are asked for: matched, ambiguous, no_sources or not_found.

    ``modules``: folder, group_id, artifact. A coordinate that several modules claim is ambiguous: all are listed.
    """
    m = modules.where("group_id IS NOT NULL AND artifact IS NOT NULL").select("folder", F.concat_ws(":", "group_id", "artifact").alias("coord"), "group_id").distinct()
    m = m.withColumn("_n", F.count("*").over(Window.partitionBy("coord"))).join(source_folders(modules, sources), "folder", "left")
    w = wanted.select(F.trim("wanted").alias("wanted")).distinct()
    exact = w.where(F.col("wanted").contains(":")).join(m, F.col("wanted") == F.col("coord"))
    group = w.where(~F.col("wanted").contains(":")).join(m, F.col("wanted") == F.col("group_id"))
    met = exact.unionByName(group).select("wanted", "coord", "source_folder", F.when(F.col("_n") > 1, "ambiguous").when(F.col("source_folder").isNull(), "no_sources").otherwise("matched").alias("status"))
    none = w.join(met.select("wanted").distinct(), "wanted", "left_anti").select("wanted", F.lit(None).cast("string").alias("coord"), F.lit(None).cast("string").alias("source_folder"), F.lit("not_found").alias("status"))
    return met.unionByName(none)
