"""Fill-in-middle: texts are cut in three at token borders and put in the order prefix, suffix, middle or suffix, prefix, middle.

DuckDB runs inside the tasks: each Arrow batch is registered as a table, one SQL text makes the
columns for all its rows, and an Arrow table goes back. No Python code sees a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import lean_task

#: Bytes of text in a registered batch; lists of tokens take some twenty times as much. A longer text is a batch of its own.
BATCH_BYTES = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: {seed}, {transformed} and {reversed} are whole numbers.
_MADE = f"""
  hashed AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
      sha256('{{seed}}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM batch),
  drawn AS (SELECT doc_id, text, tokens, len(tokens) AS n, CAST('0x' || digest[1:8] AS BIGINT) % (len(tokens) + 1) AS c1, CAST('0x' || digest[9:16] AS BIGINT) % (len(tokens) + 1) AS c2,
      CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR CAST('0x' || digest[17:24] AS BIGINT) % 100 >= {{transformed}} THEN 'plain'
        WHEN CAST('0x' || digest[25:32] AS BIGINT) % 100 < {{reversed}} THEN 'spm' ELSE 'psm' END AS form FROM hashed),
  cut AS (SELECT doc_id, text, n, form, CASE WHEN form = 'plain' THEN NULL ELSE array_to_string(list_slice(tokens, 1, least(c1, c2)), '') END AS prefix,
      CASE WHEN form = 'plain' THEN NULL ELSE array_to_string(list_slice(tokens, least(c1, c2) + 1, greatest(c1, c2)), '') END AS middle,
      CASE WHEN form = 'plain' THEN NULL ELSE array_to_string(list_slice(tokens, greatest(c1, c2) + 1, n), '') END AS suffix FROM drawn),
  made AS (SELECT doc_id, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
      CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM cut)"""

#: The original text, from form and output alone. Markers are unique in outputs that have any.
_BACK = f"""
  split AS (SELECT *, string_split(output, '{MIDDLE}') AS halves FROM {{made}}),
  sides AS (SELECT *, string_split(substr(halves[1], {len(PREFIX) + 1}), CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END) AS flanks FROM split),
  back AS (SELECT * EXCLUDE (halves, flanks), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN flanks[1] || halves[2] || flanks[2] ELSE flanks[2] || halves[2] || flanks[1] END AS restored FROM sides)"""

_ARROW = {"long": pa.int64(), "string": pa.string()}


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BATCH_BYTES of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        limit = (ends[at - 1] if at else 0) + BATCH_BYTES
        end = max(at + 1, int(np.searchsorted(ends, limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def _in_duckdb(df: DataFrame, sql: str, text_col: str, schema: dict[str, str]) -> DataFrame:
    """The rows of ``sql`` over each batch of df, registered as ``batch``."""
    target = pa.schema([(name, _ARROW[kind]) for name, kind in schema.items()])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": "1", "temp_directory": ""}) as db:
            for whole in batches:
                for batch in _pieces(whole, text_col):
                    db.register("batch", pa.Table.from_batches([batch]))
                    found = db.sql(sql).to_arrow_table().select(target.names).cast(target)
                    db.unregister("batch")
                    yield from found.to_batches()

    return df.mapInArrow(lean_task(task), ", ".join(f"{name} {kind}" for name, kind in schema.items()))


def _sql(seed: int, transformed: int, reversed_: int) -> str:
    return _MADE.format(seed=int(seed), transformed=int(transformed), reversed=int(reversed_))


def fill_in_middle(docs: DataFrame, seed: int = 1, transformed: int = 90, reversed_: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): a row for each row of docs.

    n is the number of tokens (a run of letters A to Z, or one other code point). Two cuts, the
    share of texts that are transformed (``transformed`` in a hundred) and of those that begin
    with the suffix (``reversed_`` in a hundred) come from the SHA-256 of ``seed:id``, so they are
    the same in every run. Empty texts, and texts that contain a marker, stay plain; for plain
    ones prefix_chars and middle_chars are null. Null text is empty, a null id hashes as nothing.
    Rows that share an id have the same draws; each text is cut by its own length. A text is
    handled whole, whatever its length. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sql = f"WITH {_sql(seed, transformed, reversed_)} SELECT * FROM made"
    return _in_duckdb(rows, sql, "text", {"doc_id": "long", "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"})


def restored_texts(made: DataFrame) -> DataFrame:
    """(doc_id, text): the texts that ``fill_in_middle`` was given, from form and output. Null or unknown rows don't arise there; a null output gives a null text."""
    sql = f"WITH {_BACK.format(made='batch')} SELECT doc_id, restored AS text FROM back"
    return _in_duckdb(made.select("doc_id", "form", "output"), sql, "output", {"doc_id": "long", "text": "string"})


def fill_in_middle_digests(docs: DataFrame, seed: int = 1, transformed: int = 90, reversed_: int = 20) -> DataFrame:
    """``fill_in_middle`` with the SHA-256 of each output and of the text restored from it, taken in the same task, in place of the output. Odd cases as there."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sql = f"WITH {_sql(seed, transformed, reversed_)}, {_BACK.format(made='made')} SELECT *, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM back"
    return _in_duckdb(rows, sql, "text", {"doc_id": "long", "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output_sha256": "string", "restored_sha256": "string"})
