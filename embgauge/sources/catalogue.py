"""Which datasets exist, of which family they are and where their files lie."""

from __future__ import annotations

from dataclasses import dataclass, field

from embgauge.functions.text import strip_side

# Dataset names by family.
SPLIT = ["yelpp", "imdb", "agnews", "yelpf", "trec", "sstf", "mrpc", "mrpc1", "mrpc2"]
UNSPLIT = ["mr", "cr", "subj", "mpqa"]
SIMILARITY = [
    "stsb1", "stsb2", "sts121", "sts122", "sts131", "sts132",
    "sts141", "sts142", "sts151", "sts152", "sts161", "sts162",
]
PAIR_CLASSIFICATION = ["mrpc1", "mrpc2"]


@dataclass(frozen=True)
class Entry:
    """One dataset: family, files per split, file format.

    ``columns`` maps our column names to the file's, for Parquet files with names of their own.
    ``spread`` deals the rows out by ``row_id``, for long texts in coarsely stored files.
    """

    name: str
    family: str
    files: dict = field(hash=False)
    format: str = "tsv"
    columns: dict | None = field(default=None, hash=False)
    spread: bool = False

    @property
    def paired(self) -> bool:
        return self.family == "sts" or self.name in PAIR_CLASSIFICATION

    @property
    def base_name(self) -> str:
        """Name without the side digit, for pair datasets only."""
        return strip_side(self.name) if self.paired else self.name

    @property
    def side(self) -> int | None:
        return int(self.name[-1]) if self.paired else None


class Catalogue:
    """Entries by name; asking for an unknown name is an error."""

    def __init__(self, entries):
        self._entries = {e.name: e for e in entries}

    @classmethod
    def standard(cls, root: str) -> "Catalogue":
        """The stock layout: ``sts_datasets``, ``tcls_datasets`` under ``root``."""
        entries = [Entry(n, "sts", {"test": f"{root}/sts_datasets/{n}_test.csv"}) for n in SIMILARITY]
        entries += [Entry(n, "unsplit", {"all": f"{root}/tcls_datasets/{n}.csv"}) for n in UNSPLIT]
        entries += [
            Entry(n, "split", {s: f"{root}/tcls_datasets/{n}_{s}.csv" for s in ("train", "test")}) for n in SPLIT
        ]
        return cls(entries)

    def with_entry(self, entry: Entry) -> "Catalogue":
        return Catalogue([*self._entries.values(), entry])

    def __getitem__(self, name: str) -> Entry:
        if name not in self._entries:
            raise KeyError(f"unknown dataset {name!r}")
        return self._entries[name]

    def names(self) -> list[str]:
        return sorted(self._entries)
