"""The name rules as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The tokens of a name between white space, none empty.
_TOKENS = r"filter(split(regexp_replace({0}, '(?U)^\\s+|\\s+$', ''), '(?U)\\s+'), t -> t <> '')"
_OWN, _OTHER = _TOKENS.format("name"), _TOKENS.format("relative")
_OWN_OR, _OTHER_OR = _TOKENS.format("coalesce(name, 'FNU')"), _TOKENS.format("coalesce(relative, 'FNU')")
_SHARED = f"lower(get(array_intersect({_OWN}, {_OTHER}), 0))"

FUNCTIONS = {
    "normalize_name(s STRING)": r"lower(regexp_replace(s, '(?U)^\\s+|\\s+$', ''))",
    "is_predictable(s STRING)": r"s rlike '^\\p{L}+$' and s rlike '(?i)[a-z]' and length(s) > 2",
    "last_name_fallback(name STRING, relative STRING)": f"case when size({_OWN_OR}) > 1 then element_at({_OWN_OR}, -1) when size({_OTHER_OR}) > 1 then element_at({_OTHER_OR}, -1) else 'LNU' end",
    "last_name_household(name STRING, relative STRING)": f"case when size({_OWN}) > 1 and size({_OTHER}) > 1 and element_at({_OWN}, -1) = element_at({_OTHER}, -1) and length(element_at({_OWN}, -1)) > 2 then element_at({_OWN}, -1) end",
    "last_name_shared(name STRING, relative STRING)": f"case when length({_SHARED}) >= 3 then {_SHARED} end",
    "clean_language(s STRING)": "regexp_replace(lower(s), 'hindi .including.*', 'hindi')",
    "char_bigrams(s STRING)": "case when length(s) >= 2 then transform(sequence(1, length(s) - 1), i -> substring(s, i, 2)) else array() end",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary SQL functions; Catalyst inlines their bodies. Returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
