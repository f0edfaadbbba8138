"""Fixed values and parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Results must agree on these.
PRO_SOCIETIES = ("GEMA", "ASCAP", "BMI", "SACEM", "PRS", "SABAM", "BUMA", "STIM", "SUISA", "SIAE", "SOUNDEXCHANGE", "PPL", "GVL")
ARTICLES = ("the", "a", "an", "la", "le", "les", "el", "los", "las", "su", "sus", "os", "as", "o", "il", "i")
GENERIC_TERMS = (
    "mix", "edit", "remix", "version", "dub", "rework", "bootleg", "radio", "extended", "original", "club",
    "instrumental", "vocal", "short", "long", "main", "album", "remastered", "remaster",
)
DECORATIONS = (
    r"\[full set hd\]", r"\[full set\]", r"\[4k\]", r"\[hd\]", r"\(official video\)", r"\(official\)",
    "official video", r"\[official\]", r"\(full set\)",
)
ROMANS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
PILLARS = ("house", "techno", "trance", "dnb", "hardcore", "harddance", "autres")
ROOT_PILLARS = {
    "house music": "house",
    "disco": "house",
    "UK garage": "house",
    "techno": "techno",
    "trance": "trance",
    "drum and bass": "dnb",
    "dubstep": "dnb",
    "breakbeat": "dnb",
    "hardcore": "hardcore",
    "hard dance": "harddance",
}
OTHER_PILLAR = "autres"
NOT_FOUND = "NOT_FOUND"
#: Key names and their wheel keys.
CAMELOT = {
    "Ab Minor": "1A", "G# Minor": "1A", "Eb Minor": "2A", "D# Minor": "2A", "Bb Minor": "3A", "A# Minor": "3A",
    "F Minor": "4A", "C Minor": "5A", "G Minor": "6A", "D Minor": "7A", "A Minor": "8A", "E Minor": "9A",
    "Fb Minor": "9A", "B Minor": "10A", "Cb Minor": "10A", "F# Minor": "11A", "Gb Minor": "11A", "C# Minor": "12A",
    "Db Minor": "12A", "B Major": "1B", "Cb Major": "1B", "F# Major": "2B", "Gb Major": "2B", "Db Major": "3B",
    "C# Major": "3B", "Ab Major": "4B", "G# Major": "4B", "Eb Major": "5B", "D# Major": "5B", "Bb Major": "6B",
    "A# Major": "6B", "F Major": "7B", "E# Major": "7B", "C Major": "8B", "G Major": "9B", "D Major": "10B",
    "A Major": "11B", "E Major": "12B", "Fb Major": "12B",
}


@dataclass(frozen=True)
class Similarity:
    """Track similarity: four additive segments with caps, over their sum."""

    bpm_max_diff: float = 15.0
    half_double_penalty: float = 0.9
    bpm_window: float = 16.0
    bpm_floor: float = 0.3
    era_max_diff: int = 9
    label_min_tracks: int = 3
    cap_sets: float = 3.0
    cap_playlists: float = 2.0
    cap_style: float = 2.0
    cap_context: float = 1.0
    k_sets: float = 2.0
    k_playlists: float = 0.8
    w_label: float = 0.6
    w_era: float = 0.4
    parent_weight: float = 0.5
    top_n: int = 20
    score_floor: float = 0.10
    over_provision: int = 5

    @property
    def total(self) -> float:
        return self.cap_sets + self.cap_playlists + self.cap_style + self.cap_context


@dataclass(frozen=True)
class ArtistConnections:
    cap_collabs: float = 3.0
    k_collabs: float = 1.5
    cap_sets: float = 2.0
    k_sets: float = 2.0
    cap_playlists: float = 2.0
    k_playlists: float = 0.5
    cap_style: float = 1.0
    floor: float = 0.05
    limit: int = 20

    @property
    def total(self) -> float:
        return self.cap_collabs + self.cap_sets + self.cap_playlists + self.cap_style


@dataclass(frozen=True)
class Recommendation:
    max_seeds: int = 12
    max_dislikes: int = 12
    w_like: float = 1.0
    w_library: float = 0.4
    w_dislike: float = -0.7
    per_seed: int = 40
    seed_floor: float = 0.02
    items: int = 100


@dataclass(frozen=True)
class Trends:
    window_days: int = 30
    half_life_days: float = 14.0
    set_weight: float = 3.0
    recent_days: int = 7
    velocity_cap: float = 5.0
    source_bonus: float = 0.3
    velocity_bonus: float = 0.5
    feed_rank_in_family: int = 60
    feed_rank_global: int = 200


@dataclass(frozen=True)
class SetMatching:
    w_overlap: float = 0.55
    w_title: float = 0.25
    w_order: float = 0.10
    w_first: float = 0.10
    min_shared: int = 3
    attach_overlap: float = 0.80
    attach_title: float = 0.50
    attach_max_gap: int = 2
    flag_confidence: float = 0.45
    flag_title: float = 0.90
    flag_overlap: float = 0.30
    part_title: float = 0.85
    part_overlap: float = 0.30
    unknown_duration_ms: int = 180_000

#: Fixed value: how the digest of the generic cover starts.
PLACEHOLDER_MD5 = "6e4c7dc9"
