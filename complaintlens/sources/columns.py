"""Resolution of columns by name, from the schema alone; no data is read."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Names under which exports carry their fields, in order of preference.
TEXT_NAMES = ("chunk_text", "text", "narrative_chunk", "narrative", "document")
VECTOR_NAMES = ("embedding", "vector")
ID_NAMES = ("chunk_id", "id")
NESTED_NAMES = ("metadata", "meta")
FLAT_METADATA_NAMES = (
    "complaint_id", "product_category", "product", "issue", "sub_issue",
    "company", "state", "date_received", "chunk_index", "total_chunks",
)
CHUNK_METADATA = ("product_category", "product", "issue", "company", "state", "date_received")

# Candidates for each field of a raw complaint export.
COMPLAINT_FIELDS = {
    "narrative": ("consumer_complaint_narrative", "narrative"),
    "product": ("product",),
    "company": ("company",),
    "state": ("state",),
    "date_received": ("date_received",),
    "complaint_id": ("complaint_id",),
    "issue": ("issue",),
}


def normal_name(name: str) -> str:
    """Stripped, lower case, every run of other characters one underscore, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    names = [normal_name(name) for name in df.columns]
    doubled = [name for name, n in Counter(names).items() if n > 1]
    if doubled:
        raise ValueError(f"column names that become one: {doubled}")
    return df.toDF(*names)


def _key(name: str) -> str:
    return name.lower().replace(" ", "_")


def resolve_exact_column(names: Iterable[str], *candidates: str) -> str:
    """First candidate that equals a column name, upper case and blanks aside."""
    by_key: dict[str, str] = {}
    for name in names:
        by_key.setdefault(_key(name), name)
    found = next((by_key[_key(c)] for c in candidates if _key(c) in by_key), None)
    if found is None:
        raise ValueError(f"no column named one of {candidates} in {list(by_key.values())}")
    return found


def resolve_column(names: Iterable[str], *candidates: str, exact_first: bool = True) -> str:
    """First candidate that a column name contains, upper case and blanks aside.

    With ``exact_first`` a column of exactly that name is preferred to an earlier one that
    merely contains it ("company" to "company_response").
    """
    names = list(names)
    for candidate in candidates:
        holding = [name for name in names if _key(candidate) in _key(name)]
        equal = [name for name in holding if _key(name) == _key(candidate)]
        if holding:
            return equal[0] if equal and exact_first else holding[0]
    raise ValueError(f"no column name contains one of {candidates}; found {names}")


def _optional(resolver, names: Sequence[str], *candidates: str) -> str | None:
    try:
        return resolver(names, *candidates)
    except ValueError:
        return None


@dataclass(frozen=True)
class VectorColumns:
    """Where an export of vectors has its fields."""

    text: str
    vector: str
    id: str | None = None
    nested: str | None = None
    flat: tuple[str, ...] = field(default=())

    def needed(self) -> list[str]:
        """All of them, each once, in reading order."""
        every = [self.text, self.vector, *self.flat, self.nested, self.id]
        return list(dict.fromkeys(name for name in every if name))


def detect_schema(names: Iterable[str]) -> VectorColumns:
    """Text and vector must be there; id (exact name), nested and flat metadata may be.

    Flat metadata is looked for only without a nested column.
    """
    names = list(names)
    nested = _optional(resolve_column, names, *NESTED_NAMES)
    flat: list[str] = []
    if nested is None:
        flat = [
            found for name in FLAT_METADATA_NAMES if (found := _optional(resolve_column, names, name))
        ]
    return VectorColumns(
        text=resolve_column(names, *TEXT_NAMES),
        vector=resolve_column(names, *VECTOR_NAMES),
        id=_optional(resolve_exact_column, names, *ID_NAMES),
        nested=nested,
        flat=tuple(dict.fromkeys(flat)),
    )


def resolve_complaint_columns(df: DataFrame, exact_first: bool = True) -> dict[str, str]:
    """Column of ``df`` for each field of a raw export; fails on a missing one."""
    return {
        name: resolve_column(df.columns, *candidates, exact_first=exact_first)
        for name, candidates in COMPLAINT_FIELDS.items()
    }


def rename_complaint_columns(df: DataFrame) -> DataFrame:
    """The fields of a raw export under their own names, other columns left out."""
    found = resolve_complaint_columns(df)
    return df.select(*[df[f"`{column}`"].alias(name) for name, column in found.items()])


def find_text_column(df: DataFrame) -> str:
    """The first of the usual text names that is there under exactly that name."""
    present = [name for name in TEXT_NAMES if name in df.columns]
    if not present:
        raise ValueError(f"no text column: looked for {TEXT_NAMES}, found {df.columns}")
    return present[0]


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the order of the list."""
    return df.select(*[name for name in columns if name in df.columns])


def chunk_metadata_columns(df: DataFrame) -> list[str]:
    """Metadata to carry into the chunks; the category must be among it."""
    found = [name for name in CHUNK_METADATA if name in df.columns]
    if "product_category" not in found:
        raise ValueError(f"no product_category column; found {df.columns}")
    return found


def text_column_fallback(df: DataFrame, raw: str = "consumer_complaint_narrative") -> str:
    """The cleaned narrative if the table has it, else the raw one."""
    return "clean_narrative" if "clean_narrative" in df.columns else raw


def id_column_fallback(df: DataFrame) -> str:
    """The first column with ``complaint_id`` in its name, else the first column."""
    return next((name for name in df.columns if "complaint_id" in name), df.columns[0])
