"""Array mathematics of routing: targets, losses, ranks and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.exact import array_sum


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def relative_losses(losses: Column) -> Column:
    return F.transform(losses, lambda x: x - F.array_min(losses))


def soft_targets(losses: Column, temperature: float) -> Column:
    """softmax(-(losses - min) / temperature); null unless all losses are finite."""
    if not 0 < temperature < math.inf:
        raise ValueError("temperature must be positive and finite")
    e = F.transform(losses, lambda x: F.exp(-(x - F.array_min(losses)) / temperature))
    return F.when(finite(losses), F.transform(e, lambda x: x / _sum(e)))


def soft_cross_entropy(logits: Column, targets: Column) -> Column:
    """-sum(targets * log softmax(logits))."""
    top = F.array_max(logits)
    norm = F.log(_sum(F.transform(logits, lambda x: F.exp(x - top)))) + top
    return -_sum(F.zip_with(logits, targets, lambda x, t: t * (x - norm)))


def arg_min(a: Column) -> Column:
    """Place of the first smallest element, from 0."""
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def arg_max(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def ranking(logits: Column) -> Column:
    """Places by falling logit, equal ones by place."""
    pairs = F.transform(logits, lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def mean_target_nll(prompt: Column, target: Column, logprobs: Column) -> Column:
    """Mean of -logprob over the target's places, summed without error; null unless both are non-empty, the lengths agree and all of the values are finite and at most 1e-5."""
    part = F.slice(logprobs, F.size(prompt) + 1, F.size(target))
    ok = (F.size(prompt) > 0) & (F.size(target) > 0) & (F.size(logprobs) == F.size(prompt) + F.size(target))
    return -array_sum(F.when(ok & finite(part) & F.forall(part, lambda x: x <= 1e-5), part)) / F.size(target)


def token_fingerprint(ids: Column, targets: Column) -> Column:
    """SHA-256 of the JSON list of both."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.concat(ids, targets), lambda x: x.cast("string")), ", "), F.lit("]")), 256)


def right_pad(ids: Column, width: Column, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), (width - F.size(ids)).cast("int")))


def pad_mask(ids: Column, width: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), width.cast("int")), lambda i: i <= F.size(ids))


def lr_factor(step: Column, total: int, warmup_ratio: float, least: float) -> Column:
    """Linear warm-up over ceil(total * ratio) steps, then a cosine down to `least`."""
    warm = math.ceil(total * warmup_ratio)
    progress = F.least(F.lit(1.0), (step - warm) / max(1, total - warm))
    return F.when(step < warm, (step + 1) / max(1, warm)).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(math.pi * progress)))


def sinusoid(position: Column, dim: int) -> Column:
    """Sines at even and cosines at odd places."""
    half = (dim + 1) // 2
    freq = [math.exp(-math.log(10_000) * i / max(half - 1, 1)) for i in range(half)]
    return F.array(*[(F.sin if k % 2 == 0 else F.cos)(position * freq[k // 2]) for k in range(dim)])


def scaled_log1p(x: Column, scale: float) -> Column:
    return F.log1p(x) / math.log1p(scale)


def chunked(ids: Column, size: int, pad: int = 0) -> Column:
    """Blocks of `size`, the last one padded."""
    blocks = F.ceil(F.size(ids) / size).cast("int")
    each = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.slice(ids, b * size + 1, size))
    return F.when(blocks > 0, F.transform(each, lambda x: F.concat(x, F.array_repeat(F.lit(pad).cast("long"), F.lit(size) - F.size(x)))))


def input_violation(ids: Column, mask: Column, budget: Column, vocabulary: int) -> Column:
    """The first broken rule of a request's arrays, or null."""
    return (
        F.when(F.size(ids) != F.size(mask), "shape")
        .when(~F.forall(mask, lambda m: m.isin(0, 1)), "mask_not_binary")
        .when(F.exists(F.transform(mask, lambda m, i: (i > 0) & (m == 1) & (F.get(mask, i - 1) == 0)), lambda x: x), "not_right_padded")
        .when(~F.exists(mask, lambda m: m == 1), "no_token")
        .when(~F.forall(ids, lambda t: (t >= 0) & (t < vocabulary)), "token_out_of_range")
        .when(budget.isNull() | (budget < 0), "budget")
    )
