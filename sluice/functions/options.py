"""Typed reads of the options JSON, as SQL expressions over whole columns.

A value and its error are two expressions; at most one of them is set.
"""

from __future__ import annotations

from sluice.functions.once import first_match, text

# Fixed value: prefix of every malformed-options reason.
MALFORMED = "malformed event options: "


def _malformed(reason: str) -> str:
    return text(MALFORMED + reason)


def _kind(value: str) -> str:
    """JSON kind of a variant; absent and JSON null are both VOID."""
    return f"coalesce(schema_of_variant({value}), 'VOID')"


def _field(value: str, key: str, as_type: str = "variant") -> str:
    return f"try_variant_get({value}, '$.{key}', '{as_type}')"


def _kind_of(value: str, key: str) -> str:
    return _kind(_field(value, key))


def _no_object(kind: str) -> str:
    return f"{kind} NOT LIKE 'OBJECT%' AND {kind} <> 'VOID'"


def _no_string(kind: str) -> str:
    return f"{kind} NOT IN ('STRING', 'VOID')"


def parse_json_strict(raw: str) -> str:
    """Variant of exactly one JSON document, else NULL.

    The built-in parser stops after the first document and ignores what
    follows. As the only element of an array, a document with a tail is
    refused, unless the tail closes the array itself; text with a closing
    bracket must also parse as the value of an object.
    """
    alone = f"json_array_length(concat('[', {raw}, ']')) = 1"
    closed = f"NOT contains({raw}, ']') OR try_parse_json(concat('{{\"v\":', {raw}, '}}')) IS NOT NULL"
    return f"CASE WHEN {alone} AND ({closed}) THEN try_parse_json({raw}) END"


def parse_options(raw: str) -> str:
    """The parsed options document, NULL when empty or invalid."""
    return f"CASE WHEN {raw} <> '' THEN {parse_json_strict(raw)} END"


# Fixed value: how valid JSON text of an object starts.
OBJECT_START = r"\A[ \t\n\r]*\{"


def root_error(raw: str, parsed: str) -> str:
    """Why the options column cannot be used, NULL when it can."""
    return first_match(
        (f"coalesce({raw}, '') = ''", "NULL"),
        (f"{parsed} IS NULL", _malformed("options column must be valid JSON")),
        (f"NOT {raw} RLIKE {text(OBJECT_START)} AND NOT is_variant_null({parsed})", _malformed("options column must be an object")))


def section_of(parsed: str, target: str, targets: list[str]) -> str:
    """The resolved target's section of the document, whatever its kind."""
    branches = [(f"{target} = {text(name)}", _field(parsed, name)) for name in targets]
    return first_match(*branches, otherwise="CAST(NULL AS VARIANT)")


def section_error(section: str, target: str) -> str:
    reason = f"concat({_malformed('')}, {target}, ' section must be an object')"
    return first_match((_no_object(_kind(section)), reason))


def string_error(section: str, key: str) -> str:
    return first_match((_no_string(_kind_of(section, key)), _malformed(f"{key} must be a string")))


def string_value(section: str, key: str) -> str:
    """Text option; the empty string when absent, null or not text."""
    return first_match((f"{_kind_of(section, key)} = 'STRING'", _field(section, key, "string")), otherwise="''")


def object_error(section: str, key: str) -> str:
    return first_match((_no_object(_kind_of(section, key)), _malformed(f"{key} must be an object")))


def object_value(section: str, key: str) -> str:
    """Object option as map<string,variant>; NULL when absent or no object."""
    return first_match((f"{_kind_of(section, key)} LIKE 'OBJECT%'", _field(section, key, "map<string,variant>")))


def kept_attributes(attributes: str) -> str:
    """The text-valued attributes, as map<string,string>."""
    kept = f"map_filter({attributes}, (k, v) -> {_kind('v')} = 'STRING')"
    return f"transform_values({kept}, (k, v) -> try_variant_get(v, '$', 'string'))"


def dropped_attributes(attributes: str) -> str:
    """Sorted names of the attributes that are not text."""
    return f"array_sort(map_keys(map_filter({attributes}, (k, v) -> {_kind('v')} <> 'STRING')))"


# Fixed value: padded standard base64, once line breaks are gone.
BASE64_SHAPE = r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def strict_base64(encoded: str) -> str:
    """Decoded bytes, NULL when the text is not padded standard base64."""
    packed = rf"regexp_replace({encoded}, '[\\r\\n]', '')"
    return first_match((f"{packed} RLIKE {text(BASE64_SHAPE)}", f"unbase64({packed})"))


def sqs_attribute(value: str) -> str:
    """One native attribute as struct(data_type, string_value, binary_value, error)."""
    type_kind, text_kind, binary_kind = (_kind_of(value, k) for k in ("DataType", "StringValue", "BinaryValue"))
    data_type, string_value, encoded = (_field(value, k, "string") for k in ("DataType", "StringValue", "BinaryValue"))
    names = f"map_keys(try_variant_get({value}, '$', 'map<string,variant>'))"
    error = first_match(
        (f"{_kind(value)} NOT LIKE 'OBJECT%'", "'must be a MessageAttributeValue object'"),
        (_no_string(type_kind), "'DataType must be a string'"),
        (f"coalesce({data_type}, '') = ''", "'DataType is required'"),
        (_no_string(text_kind), "'StringValue must be a string'"),
        (_no_string(binary_kind), "'BinaryValue must be a string'"),
        (f"{binary_kind} = 'STRING' AND {strict_base64(encoded)} IS NULL", "'BinaryValue must be base64'"),
        *[(f"array_contains({names}, '{k}')", f"'{k} is reserved by SQS and not supported'")
          for k in ("StringListValues", "BinaryListValues")])
    kept_text = first_match((f"{text_kind} = 'STRING'", string_value))
    kept_bytes = first_match((f"{binary_kind} = 'STRING'", strict_base64(encoded)))
    return f"named_struct('data_type', {data_type}, 'string_value', {kept_text}, 'binary_value', {kept_bytes}, 'error', {error})"


def sqs_attributes(section: str) -> str:
    """All native attributes as a map of ``sqs_attribute`` structs."""
    return f"transform_values({object_value(section, 'attributes')}, (k, v) -> {sqs_attribute('v')})"


def sqs_attributes_error(section: str, attributes: str) -> str:
    """Malformed-attributes reason; with several, that of the smallest name."""
    bad = f"filter(map_entries({attributes}), e -> e.value.error IS NOT NULL)"
    first = f"array_min(transform({bad}, e -> struct(e.key AS name, e.value.error AS error)))"
    return (f"coalesce({object_error(section, 'attributes')}, "
            f"concat({_malformed('attribute ')}, {first}.name, ': ', {first}.error))")


def delay_error(section: str) -> str:
    kind, number = _kind_of(section, "delaySeconds"), _field(section, "delaySeconds", "double")
    numeric = f"({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {kind} LIKE 'DECIMAL%')"
    whole = f"coalesce({number} = floor({number}) AND {number} BETWEEN -2147483648 AND 2147483647, false)"
    return first_match((f"{kind} <> 'VOID' AND NOT ({numeric} AND {whole})", _malformed("delaySeconds must be an integer")))


def delay_value(section: str) -> str:
    return first_match((f"{delay_error(section)} IS NULL", f"CAST({_field(section, 'delaySeconds', 'double')} AS INT)"))


def trace_error(section: str) -> str:
    path = "messageSystemAttributes"
    attributes, header = object_value(section, path), f"{path}.AWSTraceHeader"
    return f"coalesce({object_error(section, path)}, " + first_match(
        (f"size({attributes}) > 1 OR (size({attributes}) = 1 AND NOT map_contains_key({attributes}, 'AWSTraceHeader'))",
         _malformed("only AWSTraceHeader is supported in messageSystemAttributes")),
        (f"size({attributes}) = 1 AND {_no_string(_kind_of(section, header))}", _malformed("AWSTraceHeader must be a string")),
        (f"size({attributes}) = 1 AND coalesce({_field(section, header, 'string')}, '') = ''",
         _malformed("AWSTraceHeader is required"))) + ")"


def trace_value(section: str) -> str:
    header = _field(section, "messageSystemAttributes.AWSTraceHeader", "string")
    return first_match((f"{trace_error(section)} IS NULL", f"coalesce({header}, '')"), otherwise="''")
