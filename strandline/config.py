"""Knobs of an alignment run and the named presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Scoring:
    """Scores of a pairwise alignment; penalties are negative."""

    match: int = 1
    mismatch: int = -4
    gap_open: int = -6
    gap_ext: int = -1
    clip: int = -5
    unpaired: int = -17


@dataclass(frozen=True)
class ReadGroup:
    id: str
    sample: str = ""
    library: str = ""
    platform: str = ""
    unit: str = ""

    @staticmethod
    def parse(line: str) -> ReadGroup:
        """``@RG\\tID:x\\tSM:y``; a literal backslash-t counts as a tab."""
        parts = line.replace("\\t", "\t").split("\t")
        got = dict(p.split(":", 1) for p in parts if ":" in p)
        if parts[0] != "@RG" or not got.get("ID"):
            raise ValueError("a read group begins with @RG and has an ID")
        return ReadGroup(got["ID"], got.get("SM", ""), got.get("LB", ""), got.get("PL", ""), got.get("PU", ""))


@dataclass(frozen=True)
class InsertSize:
    """Distribution of the distance between mates; ``valid`` tells whether it is known."""

    mean: float = 0.0
    std: float = 0.0
    max_window: float = 0.0
    valid: bool = False

    @staticmethod
    def parse(text: str) -> InsertSize:
        """``mean[,std[,max[,min]]]``; the deviation defaults to a tenth of the mean."""
        v = [float(x) for x in text.split(",")]
        if not 1 <= len(v) <= 4 or v[0] <= 0:
            raise ValueError("an insert size is mean[,std[,max[,min]]]")
        std = v[1] if len(v) > 1 else 0.1 * v[0]
        return InsertSize(v[0], std, v[2] if len(v) > 2 else v[0] + 4 * std, True)


@dataclass(frozen=True)
class Config:
    min_seed_len: int = 9
    max_occ: int = 500
    max_gap: int = 10_000
    min_chain_score: int = 10
    band_width: int = 32
    scoring: Scoring = field(default_factory=Scoring)
    output_secondary: bool = False
    output_supplementary: bool = True
    output_xa: bool = True
    xa_max_hits: int = 5
    mark_split_secondary: bool = False
    min_output_score: int = 0
    skip_mate_rescue: bool = False
    skip_pairing: bool = False
    soft_clip_supplementary: bool = False
    smallest_coord_primary: bool = False
    read_group: ReadGroup | None = None
    insert: InsertSize = field(default_factory=InsertSize)
    header_lines: tuple[str, ...] = ()
    program: tuple[str, str] = ("strandline", "0.1.0")

    @property
    def max_alignments(self) -> int:
        """Chains of a read that are extended."""
        return min(1 + self.max_occ // 100, 4)


#: Reads above this length are aligned with the long-read knobs.
LONG_READ = 250
_noisy = Scoring(1, -1, -1, -1, 0)
PRESETS = {
    "fast": dict(min_seed_len=23, max_occ=200, band_width=16),
    "accurate": dict(min_seed_len=15, max_occ=1000, band_width=64),
    "long_reads": dict(min_seed_len=9, max_occ=10_000, max_gap=50_000, min_chain_score=20, band_width=128, scoring=Scoring(1, -1, -2, -1)),
    "ont2d": dict(min_seed_len=14, scoring=_noisy),
    "pacbio": dict(min_seed_len=17, scoring=_noisy),
    "intractable": dict(min_seed_len=19),
}
ALIASES = {"ont": "ont2d", "nanopore": "ont2d", "pb": "pacbio", "ccs": "pacbio", "sr": "intractable", "short": "intractable"}


def preset(name: str, base: Config | None = None) -> Config:
    """``base`` with the knobs of a preset; an unknown name is an error."""
    name = ALIASES.get(name, name)
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}")
    return replace(base or Config(), **PRESETS[name])
