"""Token-id arrays: labels, padding, truncation. Array expressions only, no Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label value that a loss ignores.
IGNORE = -100


def _fill(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))


def label_mask(ids: Column, keep: Column) -> Column:
    """Ids where ``keep`` is 1 (target segment, or attended position), IGNORE elsewhere."""
    return F.zip_with(ids, keep, lambda i, k: F.when(k == 1, i).otherwise(F.lit(IGNORE)))


def mask_pad(ids: Column, pad: int) -> Column:
    """Padding ids to IGNORE."""
    return F.transform(ids, lambda i: F.when(i != F.lit(pad), i).otherwise(F.lit(IGNORE)))


def unmask(labels: Column, pad: int) -> Column:
    """IGNORE back to the padding id, before decoding."""
    return F.transform(labels, lambda i: F.when(i != F.lit(IGNORE), i).otherwise(F.lit(pad)))


def take(ids: Column, n: Column) -> Column:
    """The first ``n`` elements."""
    return F.slice(ids, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def truncate_first(first: Column, second: Column, limit: int) -> tuple[Column, Column]:
    """Shorten the first part only, so that both together hold at most ``limit`` ids.

    A second part longer than ``limit`` cannot be helped by this rule and stays whole.
    """
    return take(first, F.lit(limit) - F.size(second)), second


def truncate_longest(first: Column, second: Column, limit: int) -> tuple[Column, Column]:
    """Shorten the longer part until both fit; a shorter part of at most half the limit stays whole.

    Otherwise each keeps half, and of an odd limit the longer part keeps the extra id (the
    second one, if they are equally long).
    """
    n1, n2 = F.size(first), F.size(second)
    half = limit // 2
    fits, level = n1 + n2 <= limit, F.least(n1, n2) > half

    def kept(mine: Column, other: Column, longer: Column) -> Column:
        return (F.when(fits, mine).when(level, F.when(longer, F.lit(limit - half)).otherwise(F.lit(half)))
                .when(longer, F.lit(limit) - other).otherwise(mine))
    return take(first, kept(n1, n2, n1 > n2)), take(second, kept(n2, n1, n2 >= n1))


def round_up(n: Column, multiple: int | None) -> Column:
    """``n`` raised to a multiple."""
    return (F.ceil(n / F.lit(multiple)) * multiple).cast("int") if multiple else n.cast("int")


def pad_to(ids: Column, width: Column, pad: int, side: str = "right") -> Column:
    """``ids`` filled with ``pad`` up to ``width``."""
    fill = _fill(pad, width - F.size(ids))
    return F.concat(ids, fill) if side == "right" else F.concat(fill, ids)


def attention(ids: Column, width: Column, side: str = "right") -> Column:
    """1 for a real id, 0 for filling."""
    return pad_to(F.transform(ids, lambda _: F.lit(1)), width, 0, side)


def cut_prompt(generated: Column, prompt_len: Column, width: Column | None = None, pad: int = 0) -> Column:
    """A generated sequence without its prompt, padded back to ``width`` if given."""
    rest = F.slice(generated, prompt_len.cast("int") + 1, F.greatest(F.size(generated) - prompt_len, F.lit(0)))
    return rest if width is None else pad_to(rest, width, pad)


def concat_prompt_target(prompt: Column, target: Column) -> tuple[Column, Column]:
    """(ids, labels) of prompt followed by target, the prompt ignored in the labels."""
    return F.concat(prompt, target), F.concat(_fill(IGNORE, F.size(prompt)), target)
