"""Recursive flattening and section documents for sparse retrieval.

``flatten_entries`` is built from the *schema* at plan time: the recursion runs in Python over
the ``StructType`` once and emits one native expression (``transform``/``concat``/``flatten``)
that Spark evaluates per row in the JVM - no Python per row, no shuffle. Entries keep feed key
order as ``array<struct<key, value>>`` (a map would lose order).

A typed row cannot tell an absent key from an explicit JSON null, so null struct fields and scalars are
treated as absent there. Feed files carry each item's raw JSON beside the typed struct, and ``flatten_json``
flattens that: undeclared keys, explicit nulls (``None``) and repeated flattened keys (F2) included.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DataType, IntegerType, MapType, NullType, StringType, StructType)
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from vulnsift.session import ship_package
from vulnsift.functions.text import CLEAN_KEPT_ASCII, clean_text, py_bool_str, py_list_repr

ENTRY_TYPE = "array<struct<key:string,value:string>>"

# ---- fixed values: key fragments the "rest" section skips (case-sensitive, as written) --
REST_SKIP_KEYS = ["cve_data_meta", "problemtype", "description", "references", "configurations", "impact"]
MAX_VALUE_LEN = 500
_KEPT = rf"[{CLEAN_KEPT_ASCII}\-]"
# -----------------------------------------------------------------------------------------


def _empty() -> Column:
    return F.array().cast(ENTRY_TYPE)


def _entry(key: Column, value: Column) -> Column:
    return F.array(F.struct(key.alias("key"), value.alias("value")))


def _scalar_text(c: Column, dt: DataType) -> Column:
    if isinstance(dt, BooleanType):
        return py_bool_str(c)
    if isinstance(dt, ArrayType) and isinstance(dt.elementType, StringType):
        return py_list_repr(c)
    return c.cast("string")


def _child_key(parent: Column | None, name: str) -> Column:
    return F.lit(name) if parent is None else F.concat(parent, F.lit(" " + name))


def flatten_entries(c: Column, dt: DataType, key: Column | None = None, static_key: str = "",
                    skip=None) -> Column:
    """``array<struct<key,value>>`` of every leaf under ``c`` (keys joined by a blank;
    list items get ``_i``; a non-empty all-string list is one entry joined by blanks).

    ``skip(static_key)`` may prune whole struct fields at plan time: a key only grows by
    appending, so a field whose static key is excluded has only excluded descendants."""
    if isinstance(dt, StructType):
        kids = []
        for f in dt.fields:
            sk = f.name if not static_key else f"{static_key} {f.name}"
            if skip is not None and skip(sk):
                continue
            kids.append(flatten_entries(c[f.name], f.dataType, _child_key(key, f.name), sk, skip))
        body = F.concat(*kids) if kids else _empty()
        return body if key is None else F.when(c.isNull(), _empty()).otherwise(body)
    if isinstance(dt, MapType):
        return F.when(c.isNull(), _empty()).otherwise(F.flatten(F.transform(
            F.map_entries(c), lambda e: flatten_entries(e["value"], dt.valueType,
                                                        F.concat(key, F.lit(" "), e["key"].cast("string"))))))
    if isinstance(dt, ArrayType):
        et = dt.elementType
        k = key if key is not None else F.lit("")

        def item(x, i):
            ik = F.concat(k, F.lit("_"), i.cast("string"))
            if isinstance(et, (StructType, MapType)):
                return F.when(x.isNull(), _entry(ik, F.lit("None"))).otherwise(flatten_entries(x, et, ik))
            return _entry(ik, F.coalesce(_scalar_text(x, et), F.lit("None")))

        per_item = F.flatten(F.transform(c, item))
        if isinstance(et, StringType):
            joined = _entry(k, F.array_join(c, " "))
            return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, _empty()) \
                .when(F.forall(c, lambda x: x.isNotNull()), joined).otherwise(per_item)
        return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, _empty()).otherwise(per_item)
    return F.when(c.isNull(), _empty()).otherwise(_entry(key, _scalar_text(c, dt)))


_KINDS = {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null", list: "list"}


def _typed_leaves(root, key: str) -> dict[str, tuple[str, str]]:
    """Flattened entries of one parsed JSON value with the kind of each, walked with an explicit stack (deep nesting is no
    recursion)."""
    out: dict[str, tuple[str, str]] = {}
    todo = [(key, root)]
    while todo:
        k, v = todo.pop()
        if isinstance(v, dict):
            todo.extend((f"{k} {name}" if k else name, child) for name, child in reversed(v.items()))
        elif isinstance(v, list) and v and all(type(x) is str for x in v):
            out[k] = (" ".join(v), "list")
        elif isinstance(v, list):
            todo.extend((f"{k}_{i}", x if isinstance(x, dict) else _Item(x)) for i, x in reversed(list(enumerate(v))))
        else:
            v = v.value if isinstance(v, _Item) else v
            out[k] = (str(v), _KINDS[type(v)])
    return out


class _Item:
    """An element of a mixed list that is no object: it is printed, not walked."""

    def __init__(self, value):
        self.value = value


def _leaves(root, key: str) -> dict[str, str]:
    return {k: v for k, (v, _) in _typed_leaves(root, key).items()}


class FlattenEntries:
    """F1/F2/W9 as a table function: one row for each entry of a raw JSON text, in text order, for a lateral join.

    Arguments: the text, and as constants the key to start from and whether to add ``kind``, the type that the value has in this
    very text (string, number, boolean, null, list). ``analyze`` checks them and so decides the columns. A repeated flattened key keeps
    its first place and last value; null and malformed text give no rows (F16). An item's entries are rows, so no
    array of a whole item is kept, and a later filter or aggregate works entry by entry."""

    @staticmethod
    def analyze(text: AnalyzeArgument, root: AnalyzeArgument | None = None, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, (StringType, NullType)):
            raise ValueError(f"flatten_entries needs JSON text, not {text.dataType.simpleString()}")
        for name, arg in (("root", root), ("kind", kind)):
            if arg is not None and not arg.isConstantExpression:
                raise ValueError(f"{name} must be a constant")
        out = StructType().add("pos", IntegerType()).add("key", StringType()).add("value", StringType())
        return AnalyzeResult(out.add("kind", StringType()) if kind is not None and kind.value else out)

    def eval(self, text, root="", kind=False):
        try:
            value = json.loads(text) if text is not None else {}
        except (ValueError, RecursionError):
            return
        for pos, (k, (v, of)) in enumerate(_typed_leaves(value, root or "").items()):
            yield (pos, k, v, of) if kind else (pos, k, v)


def entry_rows(df: DataFrame, text: str, root_key: str = "", kind: bool = True) -> DataFrame:
    """``df`` with a row for each entry of its JSON column: ``pos, key, value`` and ``kind``."""
    flatten = F.udtf(FlattenEntries, useArrow=True)
    return df.lateralJoin(flatten(F.col(text).outer(), F.lit(root_key), F.lit(kind)))


def flatten_json(json_text: Column, root_key: str = "") -> Column:
    """F1/F2 of a raw JSON value, any keys at any depth, in text order; a batch Arrow function, because an ordered,
    schema-free walk is no built-in. A repeated flattened key keeps its first place and last value; null prints
    ``None``; null and malformed text give no entries (F16)."""
    @F.arrow_udf(ENTRY_TYPE)
    def entries(texts: pa.Array) -> pa.Array:
        keys, values, ends = [], [], [0]
        for t in texts.to_pylist():
            try:
                value = json.loads(t) if t is not None else {}
            except (ValueError, RecursionError):
                value = {}
            found = _leaves(value, root_key)
            keys.extend(found)
            values.extend(found.values())
            ends.append(len(keys))
        pairs = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["key", "value"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
    return entries(json_text)


def flatten_item(df: DataFrame, fields: list[str], skip=None) -> Column:
    """F1 over several top-level columns as one flattened entry list, in column order."""
    st = StructType([df.schema[f] for f in fields])
    return flatten_entries(F.struct(*[F.col(f) for f in fields]), st, skip=skip)


def rest_skip(static_key: str) -> bool:
    """Plan-time form of the rest-section key exclusion (same case-sensitive fragments)."""
    return any(frag in static_key for frag in REST_SKIP_KEYS)


def _cleaned(entries: Column) -> Column:
    """Values as ``clean_text`` leaves them, but for short ASCII values that it would leave something of: the document is cleaned as a whole
    after the entries are joined, which gives the same for these, character by character."""
    def value(v: Column) -> Column:
        plain = (F.octet_length(v) < MAX_VALUE_LEN) & (F.octet_length(v) == F.length(v)) & v.rlike(_KEPT)
        return F.when(plain, v).otherwise(clean_text(v))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("value")))


def _join_entries(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" "), e["value"])), " ")


def basic_document(entries: Column) -> Column:
    """clean every value, drop empties and values longer than 500, ``key value`` joined by
    blanks, cleaned again."""
    kept = F.filter(_cleaned(entries), lambda e: (e["value"] != "") & (F.length(e["value"]) <= MAX_VALUE_LEN))
    return clean_text(_join_entries(kept))


def rest_section(entries: Column) -> Column:
    """cleaned values, non-empty and shorter than 500, whose key holds none of the skip
    fragments (case-sensitive: ``CVE_data_meta`` keys are therefore kept)."""
    skip = "|".join(REST_SKIP_KEYS)
    # the key test is cheap and drops most entries, so it runs before the values are cleaned
    kept = F.filter(_cleaned(F.filter(entries, lambda e: ~e["key"].rlike(skip))),
                    lambda e: (e["value"] != "") & (F.length(e["value"]) < MAX_VALUE_LEN))
    return _join_entries(kept)


def _lab(label: str, v: Column) -> Column:
    """``label value`` when the value is present and non-empty (W3), else null."""
    return F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(label + " "), v.cast("string")))


def _nn(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull())


def _truthy_number(v: Column) -> Column:
    """JSON-number truthiness of a score carried as text: empty and zero are false."""
    return v.isNotNull() & (v != "") & F.coalesce(v.try_cast("double") != 0, F.lit(True))


def basic_info() -> Column:
    """F5."""
    return F.concat_ws(" ", _lab("assigner", F.col("cve.CVE_data_meta.ASSIGNER")),
                       _lab("data_type", F.col("cve.data_type")), _lab("data_format", F.col("cve.data_format")))


def problem_type() -> Column:
    """every English problem-type value as ``cwe …``."""
    pd_ = F.coalesce(F.col("cve.problemtype.problemtype_data"), F.array())
    per = F.transform(pd_, lambda p: F.transform(
        F.filter(F.coalesce(p["description"], F.array().cast("array<struct<lang:string,value:string>>")),
                 lambda d: (d["lang"] == "en") & F.coalesce(d["value"] != "", F.lit(False))),
        lambda d: F.concat(F.lit("cwe "), d["value"])))
    return F.array_join(F.flatten(per), " ")


def description_section() -> Column:
    """F7."""
    dd = F.coalesce(F.col("cve.description.description_data"), F.array().cast(
        "array<struct<lang:string,value:string>>"))
    return F.array_join(F.transform(
        F.filter(dd, lambda d: (d["lang"] == "en") & F.coalesce(d["value"] != "", F.lit(False))),
        lambda d: F.concat(F.lit("description "), d["value"])), " ")


def references_section() -> Column:
    """F8: url, name, then every tag, per reference in order."""
    refs = F.coalesce(F.col("cve.references.reference_data"), F.array().cast(
        "array<struct<url:string,name:string,tags:array<string>>>"))
    per = F.transform(refs, lambda r: F.concat(
        _nn(F.array(_lab("reference_url", r["url"]), _lab("reference_name", r["name"]))),
        _nn(F.transform(F.coalesce(r["tags"], F.array().cast("array<string>")),
                        lambda t: _lab("reference_tag", t)))))
    return F.array_join(F.flatten(per), " ")


def configurations_section() -> Column:
    """operator, then per match the raw CPE URI, ``vulnerable true`` and version bounds."""
    nodes = F.coalesce(F.col("configurations.nodes"), F.array().cast(
        "array<struct<operator:string,cpe_match:array<struct<vulnerable:boolean,cpe23Uri:string,"
        "versionStartIncluding:string,versionEndIncluding:string>>>>"))
    per = F.transform(nodes, lambda n: F.concat(
        _nn(F.array(_lab("operator", n["operator"]))),
        F.flatten(F.transform(F.coalesce(n["cpe_match"], F.array().cast(
            "array<struct<vulnerable:boolean,cpe23Uri:string,versionStartIncluding:string,"
            "versionEndIncluding:string>>")), lambda m: _nn(F.array(
                _lab("cpe", m["cpe23Uri"]),
                F.when(F.coalesce(m["vulnerable"], F.lit(False)), F.lit("vulnerable true")),
                _lab("version_start", m["versionStartIncluding"]),
                _lab("version_end", m["versionEndIncluding"])))))))
    return F.array_join(F.flatten(per), " ")


def impact_section() -> Column:
    """CVSS v3 version, vector, score (falsy skipped), severity; CVSS v2 score."""
    v3 = F.col("impact.baseMetricV3.cvssV3")
    v2 = F.col("impact.baseMetricV2.cvssV2.baseScore")
    return F.concat_ws(
        " ",
        F.when(v3.isNotNull(), F.concat_ws(
            " ", _lab("cvss_version", v3["version"]), _lab("cvss_vector", v3["vectorString"]),
            F.when(_truthy_number(v3["baseScore"]), F.concat(F.lit("cvss_score "), v3["baseScore"])),
            _lab("cvss_severity", v3["baseSeverity"]))),
        F.when(_truthy_number(v2), F.concat(F.lit("cvss_v2_score "), v2)))


def dates_section() -> Column:
    """F11."""
    return F.concat_ws(" ", _lab("published", F.col("publishedDate")), _lab("modified", F.col("lastModifiedDate")))


def advanced_document(entries: Column) -> Column:
    """sections F5-F12 in order, empty ones skipped, joined by a blank and cleaned."""
    parts = [basic_info(), problem_type(), description_section(), references_section(),
             configurations_section(), impact_section(), dates_section(), rest_section(entries)]
    return clean_text(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def sparse_documents(items: DataFrame, mode: str = "advanced", fields: list[str] | None = None) -> DataFrame:
    """``(id_cve, documents)`` per item with a known id (W1, W2), id lower-cased.

    ``mode`` picks the builder explicitly: ``"advanced"`` (F13) or ``"basic"`` (F4)."""
    from vulnsift.sources.feed import ITEM_FIELDS
    fields = fields or [f for f in ITEM_FIELDS if f in items.columns]
    if "raw" in items.columns:                  # whole feed items: every key, declared or not
        ship_package(items.sparkSession)
        entries = flatten_json(F.col("raw"))
        doc = advanced_document(entries) if mode == "advanced" else basic_document(entries)
    elif mode == "advanced":
        # the rest section only keeps keys without the skip fragments: prune those subtrees
        # from the flatten expression itself (the runtime key filter still applies)
        doc = advanced_document(flatten_item(items, fields, skip=rest_skip))
    else:
        doc = basic_document(flatten_item(items, fields))
    cid = F.col("cve.CVE_data_meta.ID")
    out = items.where(cid.isNotNull() & (F.coalesce(cid, F.lit("unknown")) != "unknown"))
    keep = [c for c in ("pos",) if c in items.columns]
    # (clean_text never returns null, so no filter on the document: a filter on it would be
    # pushed below the projection and evaluate the whole document expression twice)
    return out.select(*keep, F.lower(cid).alias("id_cve"), doc.alias("documents"))
