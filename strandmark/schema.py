"""Table schemas, modification codes and column labels."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

CALL_TSV = T.StructType(
    [T.StructField(n, t) for n, t in (("read_id", T.StringType()), ("forward_read_position", T.LongType()), ("chrom", T.StringType()), ("ref_position", T.LongType()), ("ref_mod_strand", T.StringType()), ("read_length", T.LongType()), ("query_kmer", T.StringType()), ("call_prob", T.DoubleType()), ("call_code", T.StringType()), ("base_qual", T.LongType()), ("flag", T.LongType()))]
)
ARCHIVE_COLUMNS = ["sample_name", "read_id", "chrom", "start", "end", "read_position", "read_length", "query_kmer", "call_prob", "call_code", "base_qual", "flag"]
CALLS_COLUMNS = ["sample_name", "read_id", "chrom", "start", "end", "read_position", "query_kmer", "call_code", "read_length", "call_prob", "base_qual", "flag"]
#: types to which calls are normalised at ingest
CALL_TYPES = {"start": "long", "end": "long", "read_position": "long", "read_length": "long", "call_prob": "double", "base_qual": "long", "flag": "long"}
#: chromosomes that summaries keep by default (fixed values); None keeps all
DEFAULT_CHRS = [f"chr{c}" for c in [*range(1, 23), "X", "Y", "M"]] + [str(c) for c in range(1, 23)]
DEFAULT_MODS = ("m", "h", "m + h")


@dataclass(frozen=True)
class ModSpec:
    """A count column: the call codes that it counts."""

    label: str
    codes: tuple[str, ...]

    @property
    def column(self) -> str:
        return f"m_{self.label}" if re.fullmatch(r"\d+", self.label) else self.label


def parse_mods(mod_code=DEFAULT_MODS, unmod_code: str | list[str] = "-", unmod_label: str = "c") -> list[ModSpec]:
    """Unmodified first; "m + h" counts either code under the label mh."""
    codes = (unmod_code,) if isinstance(unmod_code, str) else tuple(unmod_code)
    specs = [ModSpec(unmod_label, codes)]
    for text in [mod_code] if isinstance(mod_code, str) else mod_code:
        parts = tuple(re.sub(r"\s+", "", text).split("+"))
        specs.append(ModSpec("".join(parts), parts))
    return specs
