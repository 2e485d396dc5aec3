"""Requests and responses of version 1: parsing and checks of requests, responses as JSON, and their JSON Schema."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# The version, the enumerations and the fields of each message.
VERSION = "v1"
MIME = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx"}
REASONS = ("CORE_GATE_FAILED", "NO_SKILL_OVERLAP", "BELOW_SCORE_FLOOR")
ERRORS = ("PARSE_FAILED", "UNSUPPORTED_MIME", "EMPTY_DOCUMENT", "TAXONOMY_LOAD_FAILED", "BACKEND_UNAVAILABLE", "INTERNAL_ERROR")
MOST_ROLES, ROLES = 10, 5
REQUEST = (
    "schema_version string, request_id string, user_id string, "
    "input struct<kind:string,content_base64:string,mime_type:string,filename:string>, options struct<max_roles:int,backend:string>"
)
RESPONSE = (
    "schema_version string, request_id string, user_id string, generated_at string, versions struct<taxonomy:string,extractor:string,prompt:string>, "
    "extracted_skills array<struct<skill_id:string,matched_alias:string,span:array<int>>>, "
    "matches array<struct<role_id:string,display_name:string,score:double,core_ratio:double,matched_skills:array<string>,missing_skills:array<string>>>, "
    "excluded_roles array<struct<role_id:string,reason:string,core_ratio:double>>, warnings array<string>"
)
ERROR = "schema_version string, request_id string, error struct<code:string,detail:string,retryable:boolean>"
OPTIONAL = {"options", "max_roles", "backend", "prompt", "warnings"}
RANGES = {"score": (0, 1), "core_ratio": (0, 1), "max_roles": (1, MOST_ROLES)}
CHOICES = {"schema_version": (VERSION,), "kind": ("file",), "mime_type": tuple(MIME), "reason": REASONS, "code": ERRORS}


def _names(ddl: str, field: str | None = None) -> list[str]:
    kind = StructType.fromDDL(ddl)
    return (kind[field].dataType if field else kind).fieldNames()


def parsed(messages: DataFrame, column: str = "body") -> DataFrame:
    """``messages`` with ``request`` and ``problem``, the first rule of the contract that a request breaks, or null.

    Order: no JSON object, unknown field, field missing, version, kind, type of file, number of roles,
    content that is no base64. A missing number of roles is the default.
    """
    body = F.col(column)
    r = F.from_json(body, REQUEST)
    level = {"$": _names(REQUEST), "$.input": _names(REQUEST, "input"), "$.options": _names(REQUEST, "options")}
    at = lambda p: body if p == "$" else F.get_json_object(body, p)
    extra = [F.size(F.array_except(F.json_object_keys(at(p)), F.array(*map(F.lit, own)))) > 0 for p, own in level.items()]
    missing = [F.get_json_object(body, f"$.{n}").isNull() for n in ("schema_version", "request_id", "user_id")]
    missing += [F.get_json_object(body, f"$.input.{n}").isNull() for n in _names(REQUEST, "input")]
    roles = F.get_json_object(body, "$.options.max_roles")
    any_of = lambda xs: F.greatest(*[F.coalesce(x, F.lit(False)) for x in xs])
    problem = (
        F.when(body.isNull() | F.json_object_keys(body).isNull(), "not an object")
        .when(any_of(extra), "unknown field").when(any_of(missing), "missing field")
        .when(F.get_json_object(body, "$.schema_version") != VERSION, "schema_version")
        .when(F.get_json_object(body, "$.input.kind") != "file", "kind")
        .when(~F.get_json_object(body, "$.input.mime_type").isin(*MIME), "mime_type")
        .when(roles.isNotNull() & ~F.coalesce(roles.try_cast("int").between(1, MOST_ROLES) & roles.rlike("^[0-9]+$"), F.lit(False)), "max_roles")
        .when(F.try_to_binary(F.get_json_object(body, "$.input.content_base64"), F.lit("base64")).isNull(), "content_base64")
    )
    return messages.withColumn("request", r).withColumn("problem", problem)


def files(requests: DataFrame) -> DataFrame:
    """(request_id, user_id, path, content, max_roles) of the sound requests, as the readers of files take them."""
    r = F.col("request")
    ending = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[r["input"]["mime_type"]]
    return requests.where("problem is null").select(
        r["request_id"].alias("request_id"), r["user_id"].alias("user_id"), F.concat_ws(".", r["request_id"], ending).alias("path"),
        F.unbase64(r["input"]["content_base64"]).alias("content"), F.coalesce(r["options"]["max_roles"], F.lit(ROLES)).alias("max_roles"))


def errors(requests: DataFrame) -> DataFrame:
    """(request_id, body): the error response to each request that breaks the contract."""
    code = F.when(F.col("problem") == "mime_type", "UNSUPPORTED_MIME").otherwise("PARSE_FAILED")
    error = F.struct(code.alias("code"), F.col("problem").alias("detail"), F.lit(False).alias("retryable"))
    rid = F.coalesce(F.col("request")["request_id"], F.lit(""))
    body = F.struct(F.lit(VERSION).alias("schema_version"), rid.alias("request_id"), error.alias("error"))
    return requests.where("problem is not null").select(rid.alias("request_id"), F.to_json(body).alias("body"))


def responses(candidates: DataFrame, mentions: DataFrame, covered: DataFrame, names: DataFrame, taxonomy: str, extractor: str,
              generated_at: Column | None = None, key: str = "request_id") -> DataFrame:
    """(key, body): one response for each row of ``candidates`` (key, user_id, max_roles), also where nothing was found.

    ``mentions`` has (key, skill_id, matched_alias, start, end), ``covered`` the coverage of all roles,
    ``names`` (role_id, display_name). All three are grouped by key, so no text is moved.
    """
    c = F.col
    skills = mentions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        c("start"), F.struct("skill_id", "matched_alias", F.array("start", "end").alias("span")).alias("x")))).alias("s"))
    rows = covered.join(names, "role_id", "left").withColumn("display_name", F.coalesce("display_name", "role_id"))
    match = F.when(c("passed"), F.struct((-c("score")).alias("o"), c("role_id"), F.struct(
        "role_id", "display_name", "score", "core_ratio", c("matched").alias("matched_skills"), c("missing").alias("missing_skills")).alias("x")))
    out = F.when(~c("passed"), F.struct(c("role_id"), F.lit(REASONS[0]).alias("reason"), c("core_ratio")))
    roles = rows.groupBy(key).agg(F.array_sort(F.collect_list(match)).alias("m"), F.array_sort(F.collect_list(out)).alias("e"))
    empty = lambda field: F.array().cast(StructType.fromDDL(RESPONSE)[field].dataType)
    body = F.struct(
        F.lit(VERSION).alias("schema_version"), c(key).alias("request_id"), "user_id",
        F.date_format(generated_at if generated_at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        F.struct(F.lit(taxonomy).alias("taxonomy"), F.lit(extractor).alias("extractor"), F.lit(None).cast("string").alias("prompt")).alias("versions"),
        F.coalesce(F.transform("s", lambda x: x["x"]), empty("extracted_skills")).alias("extracted_skills"),
        F.coalesce(F.transform(F.slice("m", 1, c("max_roles")), lambda x: x["x"]), empty("matches")).alias("matches"),
        F.coalesce("e", empty("excluded_roles")).alias("excluded_roles"),
        F.when(c("s").isNull(), F.array(F.lit("no skill was found"))).otherwise(empty("warnings")).alias("warnings"),
    )
    joined = candidates.join(skills, key, "left").join(roles, key, "left")
    return joined.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def out_of_range(df: DataFrame, key: str) -> DataFrame:
    """(key, field, value) of the numbers and choices of ``df`` that the contract doesn't allow; absent columns are not checked."""
    bad = []
    for name in df.columns:
        if name in RANGES:
            bad.append(F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("value"), (~F.col(name).between(*RANGES[name])).alias("bad")))
        elif name in CHOICES:
            bad.append(F.struct(F.lit(name).alias("field"), F.col(name).alias("value"), (~F.col(name).isin(*CHOICES[name])).alias("bad")))
    rows = df.select(key, F.explode(F.array(*bad)).alias("x"))
    return rows.where(F.coalesce("x.bad", F.lit(True))).select(key, "x.field", "x.value")


def schema(ddl: str) -> dict:
    """The JSON Schema of a message: no fields besides its own, ranges and choices included."""
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **_schema(StructType.fromDDL(ddl), "")}


def _schema(kind, name: str) -> dict:
    if isinstance(kind, StructType):
        need = [f.name for f in kind if f.name not in OPTIONAL]
        return {"type": "object", "additionalProperties": False, "required": need, "properties": {f.name: _schema(f.dataType, f.name) for f in kind}}
    if isinstance(kind, ArrayType):
        two = {"minItems": 2, "maxItems": 2} if name == "span" else {}
        return {"type": "array", "items": _schema(kind.elementType, ""), **two}
    out: dict = {"type": {"string": "string", "int": "integer", "double": "number", "boolean": "boolean"}[kind.simpleString()]}
    if name in RANGES:
        out |= dict(zip(("minimum", "maximum"), RANGES[name]))
    if name in CHOICES:
        out["enum"] = list(CHOICES[name])
    if name == "generated_at":
        out["format"] = "date-time"
    if name in ("backend", "prompt"):
        out["type"] = ["string", "null"]
    return out


def export(folder: str) -> list[str]:
    """Writes the three schemas; their paths."""
    out = []
    for name, ddl in (("request", REQUEST), ("response", RESPONSE), ("error", ERROR)):
        path = Path(folder) / f"{name}.schema.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(schema(ddl), indent=2) + "\n", encoding="utf-8")
        out.append(str(path))
    return out
