"""Configurations as rows: every JSON file of a folder is checked at once, with strict types, and each broken rule is a row.

A rule is SQL over the file's fields: `kind(x)` is the type that the JSON has (so 1.0 and true are no integers), `number(x)`, `text(x)` and
`items(x)` are the value, null unless it is of that type.  A rule that isn't true is broken, so a missing field breaks every rule on it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FINITE = "abs(number({0})) < double('infinity')"


def _positive(name: str) -> str:
    return f"{_FINITE.format(name)} AND number({name}) > 0"


def _whole(name: str, least: int) -> str:
    return f"kind({name}) = 'BIGINT' AND number({name}) >= {least}"


#: What a router's architecture must be.
ARCHITECTURE = {
    "names": "length(text(model_family)) > 0 AND length(text(architecture_version)) > 0",
    "expert_ids": "size(items(expert_ids)) > 0 AND size(array_distinct(items(expert_ids))) = size(items(expert_ids)) AND forall(items(expert_ids), x -> length(x) > 0)",
    "dimensions": "number(embedding_dim) > 0 AND number(hidden_dim) > 0",
    "num_heads": "number(num_heads) >= 1 AND number(hidden_dim) % number(num_heads) = 0",
    "encoder_layers": "number(encoder_layers) = 2",
    "chunk_size": "number(chunk_size) >= 1",
    "dropout": "number(dropout) >= 0 AND number(dropout) < 1",
    "scales": "number(length_scale) > 0 AND number(generation_scale) > 0",
}
#: What a training configuration must be.
TRAINING = {
    "paths": " AND ".join(f"length(text({c})) > 0" for c in ("architecture_config", "train_data", "valid_data", "base_model_path", "embedding_weight_key", "output_dir")),
    "seed": "kind(seed) = 'BIGINT'",
    **{c: _whole(c, n) for c, n in (("epochs", 1), ("batch_size", 1), ("num_workers", 0), ("max_prompt_tokens", 1))},
    "pin_memory": "kind(pin_memory) = 'BOOLEAN'",
    "precision": "text(precision) = 'bf16'",
    "betas": "size(numbers(betas)) = 2 AND forall(numbers(betas), x -> x >= 0 AND x < 1)",
    **{c: _positive(c) for c in ("lr", "eps", "max_grad_norm", "temperature")},
    "weight_decay": f"{_FINITE.format('weight_decay')} AND number(weight_decay) >= 0",
    "warmup_ratio": "number(warmup_ratio) >= 0 AND number(warmup_ratio) < 1",
    "min_lr_ratio": "number(min_lr_ratio) >= 0 AND number(min_lr_ratio) <= 1",
}
_KIND = "schema_of_variant(try_variant_get(v, '$.{0}', 'variant'))"
_VALUE = {
    "kind": f"regexp_replace({_KIND}, '^DECIMAL.*', 'DECIMAL')",
    "number": f"CASE WHEN {_KIND} RLIKE '^(BIGINT|DOUBLE|DECIMAL)' THEN try_variant_get(v, '$.{{0}}', 'double') END",
    "text": f"CASE WHEN {_KIND} = 'STRING' THEN try_variant_get(v, '$.{{0}}', 'string') END",
    "items": f"CASE WHEN {_KIND} = 'ARRAY<STRING>' THEN try_variant_get(v, '$.{{0}}', 'array<string>') END",
    "numbers": f"CASE WHEN {_KIND} RLIKE '^ARRAY<(BIGINT|DOUBLE|DECIMAL)' THEN try_variant_get(v, '$.{{0}}', 'array<double>') END",
}


def _sql(rule: str) -> str:
    return re.sub(r"\b(kind|number|text|items|numbers)\((\w+)\)", lambda m: f"({_VALUE[m[1]].format(m[2])})", rule)


def violations(configs: DataFrame, rules: dict[str, str], path: str = "path", value: str = "value") -> DataFrame:
    """(path, problem) of every rule that a configuration (its JSON text) breaks; `json` alone for one that can't be read."""
    parsed = configs.select(path, F.try_parse_json(value).alias("v"))
    broken = [F.when(~F.coalesce(F.expr(_sql(rule)), F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    problems = F.when(F.col("v").isNull(), F.array(F.lit("json"))).otherwise(F.array_compact(F.array(*broken)))
    return parsed.select(path, F.explode(problems).alias("problem"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
