"""Text columns: tokens, query fields, clean-up. All of it built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data formats.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
NAME_MARK = ":"
SCHEMA_MARK = " | "
# White space in the wide sense: control characters and every Unicode separator.
WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def strip(text: Column | str) -> Column:
    """Without white space at either end."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(col, rf"^{WHITE}+|{WHITE}+\z", "")


def white_split(text: Column | str) -> Column:
    """White-space separated parts, none of them empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(col, f"{WHITE}+"), lambda t: t != "")


def tokens(text: Column | str) -> Column:
    """Lower-cased words and single punctuation marks of a text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0))


def token_length(text: Column | str) -> Column:
    """Number of word tokens."""
    return F.size(tokens(text)).cast("long")


def leading_letters(text: Column | str, n: int = 3) -> Column:
    """Coarse word classes of a text: the distinct first ``n`` letters of its words."""
    return F.array_distinct(F.transform(word_list(text), lambda w: F.substring(w, 1, n)))


def word_list(text: Column | str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def custom_perplexity(ll: Column | str, length: Column | str) -> Column:
    """exp(-ll / length); null for an empty text."""
    ll = F.col(ll) if isinstance(ll, str) else ll
    length = F.col(length) if isinstance(length, str) else length
    return F.exp(-F.try_divide(ll, length.cast("double")))


def _head(col: Column, mark: str) -> Column:
    return F.substring_index(col, mark, 1)


def _rest(col: Column, mark: str) -> Column:
    return F.when(F.contains(col, F.lit(mark)),
                  F.substr(col, F.instr(col, F.lit(mark)) + F.lit(len(mark))))


def _query_fields(df: DataFrame, query: str, has_name: Column, has_schema: Column) -> DataFrame:
    col = F.col(query)
    body = F.when(has_name, _rest(col, NAME_MARK)).otherwise(col)
    schema = F.when(has_schema, F.concat(F.lit(SCHEMA_MARK), _rest(body, SCHEMA_MARK)))
    return df.withColumns({
        "table_name": F.when(has_name, _head(col, NAME_MARK)).otherwise(F.lit("")),
        "table_schema_str": F.coalesce(schema, F.lit("")),
        query: F.when(has_schema, _head(body, SCHEMA_MARK)).otherwise(body),
    })


def split_query_fields(df: DataFrame, query: str = "query") -> DataFrame:
    """``name: question | schema`` into table_name, query and table_schema_str, row by row."""
    col = F.col(query)
    return _query_fields(df, query, F.contains(col, F.lit(NAME_MARK)), F.contains(col, F.lit(SCHEMA_MARK)))


def split_query_fields_all(df: DataFrame, query: str = "query") -> DataFrame:
    """The same, but a field is taken only if every row of the table carries its mark."""
    col = F.col(query)
    every = df.agg(F.bool_and(F.contains(col, F.lit(NAME_MARK))),
                   F.bool_and(F.contains(col, F.lit(SCHEMA_MARK)))).first()
    return _query_fields(df, query, F.lit(bool(every[0])), F.lit(bool(every[1])))


def strip_name(query: Column | str) -> Column:
    """Text after the first ``:``, trimmed; unchanged without one."""
    col = F.col(query) if isinstance(query, str) else query
    return strip(F.coalesce(_rest(col, NAME_MARK), col))


def strip_schema(query: Column | str) -> Column:
    """Text before the first `` | ``, trimmed."""
    col = F.col(query) if isinstance(query, str) else query
    return strip(_head(col, SCHEMA_MARK))


def question_only(query: Column | str) -> Column:
    """The question part of a text-to-SQL row."""
    return strip_schema(strip_name(query))


def split_last_word(text: Column | str) -> tuple[Column, Column]:
    """(all but the last space-separated word, space plus the last word)."""
    col = F.col(text) if isinstance(text, str) else text
    last = F.substring_index(col, " ", -1)
    keep = F.length(col) - F.length(last) - 1
    context = F.when(keep > 0, F.substr(col, F.lit(1), keep)).otherwise(F.lit(""))
    return context, F.concat(F.lit(" "), last)


def normalize_prediction(text: Column | str, repair: bool = True) -> Column:
    """Trim; with ``repair`` also undo the split of ``<=`` that a subword vocabulary leaves."""
    col = strip(text)
    return F.replace(col, F.lit("< ="), F.lit(" <=")) if repair else col
