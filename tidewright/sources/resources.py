"""Registrations and bindings of frameworks, from resource files and annotated methods, as edges ``caller, callee, kind, path``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .files import lines

# Annotations of the frameworks by what calls the methods that carry them.
METHOD_KINDS = {
    "spring_event_listener": ("EventListener", "TransactionalEventListener"), "spring_framework_callback": ("PostConstruct", "PreDestroy", "Scheduled", "Bean", "KafkaListener", "RabbitListener", "JmsListener", "Async"),
    "spring_runtime_active_entry": ("RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "MessageMapping", "ExceptionHandler"),
    "jpa_lifecycle_callback": ("PrePersist", "PostPersist", "PreUpdate", "PostUpdate", "PreRemove", "PostRemove", "PostLoad"), "spring_transaction_proxy_dispatch": ("Transactional",), "spring_aop_activation": ("Before", "After", "Around", "AfterReturning", "AfterThrowing"),
    "mybatis_annotation_binding": ("Select", "Insert", "Update", "Delete", "SelectProvider", "InsertProvider", "UpdateProvider", "DeleteProvider"),
}
TYPE_KINDS = {"declarative_http_client_outbound": ("FeignClient", "HttpExchange"), "mybatis_mapper_proxy_dispatch": ("Mapper",), "spring_data_repository_proxy_dispatch": ("Repository", "RepositoryDefinition")}
_NAME = r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*"


def _edges(df: DataFrame, caller: Column, callee: Column, kind: str | Column) -> DataFrame:
    return df.select(caller.alias("caller"), callee.alias("callee"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), "path").where("caller != '' AND callee != ''").distinct()


def registrations(files: DataFrame) -> DataFrame:
    """What service files register: java_spi_, dubbo_spi_, spring_factories_ and spring_autoconfiguration_registration, from interface to implementation.

    ``files``: path, text. Comments (#) and blank lines are passed over; a list goes on after a backslash or comma at the end of a line.
    """
    joined = files.withColumn("text", F.regexp_replace("text", r"\\\s*(?:\r\n|\n|\r)[ \t]*", ""))
    each = lines(joined).withColumn("line", F.trim(F.regexp_replace("line", r"#.*$", ""))).where("line != ''")
    service, dubbo = F.regexp_extract("path", r"META-INF/services/([\w.$]+)$", 1), F.regexp_extract("path", r"META-INF/dubbo/(?:internal/|external/)?([\w.$]+)$", 1)
    key, value = F.trim(F.substring_index("line", "=", 1)), F.trim(F.substring_index("line", "=", -1))
    listed = each.where(F.col("path").endswith("META-INF/spring.factories") & F.col("line").contains("=")).select("path", key.alias("key"), F.explode(F.split(value, r"\s*,\s*")).alias("value"))
    imports = each.where(F.col("path").rlike(r"META-INF/spring/[\w.]+\.imports$"))
    return reduce(DataFrame.unionByName, [
        _edges(each.where(service != ""), service, F.col("line"), "java_spi_registration"), _edges(each.where(dubbo != ""), dubbo, value, "dubbo_spi_registration"),
        _edges(listed, F.col("key"), F.col("value"), "spring_factories_registration"), _edges(imports, F.regexp_extract("path", r"([\w.]+)\.imports$", 1), F.col("line"), "spring_autoconfiguration_registration"),
    ])


def load_points(calls: DataFrame) -> DataFrame:
    """Where code loads services: java_spi_load_point from the calling method to ServiceLoader. ``calls`` as of javatext.calls."""
    hit = calls.where("member = 'load' AND receiver_type LIKE '%ServiceLoader'")
    return _edges(hit, F.concat_ws(".", "type", "method"), F.lit("java.util.ServiceLoader.load"), "java_spi_load_point")


def annotated(methods: DataFrame) -> DataFrame:
    """Edges from a framework to the methods that its annotations, or those of their types, expose to it. ``methods`` as of javatext.methods."""
    name = F.concat("type", F.lit("."), "method", "params")

    def kinds(column: str, known: dict) -> Column:
        return F.array_compact(F.array(*[F.when(F.arrays_overlap(column, F.array(*map(F.lit, marks))), F.lit(kind)) for kind, marks in known.items()]))

    found = methods.where("problem IS NULL").withColumn("kind", F.explode(F.array_union(kinds("annotations", METHOD_KINDS), kinds("type_annotations", TYPE_KINDS))))
    return _edges(found, F.concat(F.lit("framework:"), "kind"), name, F.col("kind"))


def mybatis_bindings(files: DataFrame) -> DataFrame:
    """Edges of mapper XML (path, text): mybatis_mapper_binding from the mapper's method to the statement, mybatis_type_reference to the types that it names,
    mybatis_type_handler_binding to handlers. Files with a document type that defines entities are passed over, as are other documents."""
    good = files.where(F.col("text").rlike(r"<mapper\b") & ~F.col("text").rlike(r"(?i)<!ENTITY|<!DOCTYPE[^>]*\["))
    space = F.regexp_extract("text", r"<mapper\b[^>]*\bnamespace\s*=\s*[\"']([^\"']+)[\"']", 1)
    clean = good.withColumn("text", F.regexp_replace("text", r"(?s)<!--.*?-->", "")).withColumn("space", space).where("space != ''")
    statements = clean.select("path", "space", F.explode(F.regexp_extract_all("text", F.lit(r"<(?:select|insert|update|delete)\b([^>]*)>"), F.lit(1))).alias("tag"))
    name = F.regexp_extract("tag", r"\bid\s*=\s*[\"']([^\"']+)[\"']", 1)
    bound = statements.where(name != "").withColumn("method", F.concat("space", F.lit("."), name))
    types = bound.select("path", "method", F.explode(F.regexp_extract_all("tag", F.lit(rf"\b(?:parameterType|resultType)\s*=\s*[\"']({_NAME})[\"']"), F.lit(1))).alias("type"))
    handlers = clean.select("path", "space", F.explode(F.regexp_extract_all("text", F.lit(rf"\btypeHandler\s*=\s*[\"']?({_NAME})"), F.lit(1))).alias("type"))
    return reduce(DataFrame.unionByName, [
        _edges(bound, F.col("method"), F.concat(F.lit("sql:"), "method"), "mybatis_mapper_binding"), _edges(types, F.col("method"), F.col("type"), "mybatis_type_reference"), _edges(handlers, F.col("space"), F.col("type"), "mybatis_type_handler_binding"),
    ])


def spring_xml(files: DataFrame) -> DataFrame:
    """Edges of bean definitions in XML (path, text): spring_bean_dispatch from a bean's name to its class, spring_xml_property_injection to the beans it refers to."""
    good = files.where(F.col("text").rlike(r"<beans\b") & ~F.col("text").rlike(r"(?i)<!ENTITY|<!DOCTYPE[^>]*\["))
    beans = good.select("path", F.explode(F.regexp_extract_all(F.regexp_replace("text", r"(?s)<!--.*?-->", ""), F.lit(r"(?s)<bean\b(.*?)(?:/>|</bean>)"), F.lit(1))).alias("bean"))
    attribute = lambda a: F.regexp_extract(F.substring_index("bean", ">", 1), rf"\b{a}\s*=\s*[\"']([^\"']+)[\"']", 1)
    named = beans.withColumn("name", F.coalesce(F.nullif(attribute("id"), F.lit("")), F.nullif(attribute("name"), F.lit("")), attribute("class"))).withColumn("class", attribute("class"))
    refs = named.select("path", "name", F.explode(F.regexp_extract_all("bean", F.lit(r"<property\b[^>]*\bref\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))).alias("ref"))
    return _edges(named, F.col("name"), F.col("class"), "spring_bean_dispatch").unionByName(_edges(refs, F.col("name"), F.col("ref"), "spring_xml_property_injection"))


def reflection(calls: DataFrame) -> DataFrame:
    """Uses by name, ``caller, owner, member, kind, reason``: class look-ups, reflective members and method handles; where the name isn't a literal, ``reason`` says so."""
    kind = (
        F.when((F.col("member") == "forName") | (F.col("member") == "loadClass"), "reflection_class_lookup").when(F.col("member").isin("getMethod", "getDeclaredMethod"), "reflection_method_invocation")
        .when(F.col("member").isin("getField", "getDeclaredField"), "reflection_field_access").when(F.col("member").isin("findVirtual", "findStatic", "findSpecial"), "method_handle_invocation")
        .when(F.col("member").isin("findGetter", "findSetter", "findVarHandle"), "method_handle_field_access").when(F.col("member").isin("getConstructor", "getDeclaredConstructor"), "reflection_constructor_invocation")
    )
    found = calls.withColumn("use", kind).where("use IS NOT NULL")
    lookup = F.col("use") == "reflection_class_lookup"
    reason = F.when(F.col("literal").isNull() & (F.col("use") != "reflection_constructor_invocation"), F.when(lookup, "DYNAMIC_CLASS_NAME").otherwise("DYNAMIC_MEMBER_NAME"))
    return found.select(F.concat_ws(".", "type", "method").alias("caller"), F.when(lookup, F.col("literal")).alias("owner"), F.when(~lookup, F.col("literal")).alias("member"), F.col("use").alias("kind"), reason.alias("reason"))
