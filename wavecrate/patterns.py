"""Patterns and separators on which results must agree."""

from __future__ import annotations

# Fixed values, artist names
BULLET_PREFIX = r"(?i)^\s*(?:vinyl\s*)?[•·]\s*"
DOTTED_INITIALS = r"^(?:\p{L}\.){2,}\p{L}?\.?$"
FOLDED_PUNCTUATION = r"[.,'\-·•]"
FIRST_ARTIST = (", ", " & ", " feat. ", " feat ", " ft. ", " ft ", " x ", " X ")
FLAT_ARTISTS = r"(?i)\s*(?:,\s*|\s+&\s+|\s+feat\.?\s+|\s+ft\.?\s+|\s+x\s+|\s+vs\.?\s+)"
FEATURING = r"(?i)\s+(?:feat\.?|featuring|ft\.?|vs\.?)\s+"
PRESENTING = r"(?i)\s+(?:presents|présente|pres\.?)\s+"

# Fixed values, track titles
FEATURE_BRACKETS = r"\s*[(\[]\s*(?:featuring|feat|ft)\b\.?\s[^)\]]*[)\]]"
FEATURE_TAIL = r"\s+(?:featuring|feat|ft)\b\.?\s[^(\[]*$"
ORIGINAL_MARK = r"\s*[(\[]\s*original(?:\s+mix)?\s*[)\]]\s*$"
SAFE_SUFFIX = (
    r"(?i)\s*[(\[]\s*(?:(?:Extended|Original|Radio|Club|Dub|Instrumental|Short|Long)(?:\s+(?:Mix|Edit|Version))?"
    r"|Album Version|Main Mix|Remastered(?:\s+\d{4})?|feat\.?\s+[^)\]]*|ft\.?\s+[^)\]]*)\s*[)\]]"
)
UNIDENTIFIED = ("id", "id - id", "?", "??", "unknown", "")

# Fixed values, set titles
SEPARATORS = " \\| | – | — "
SET_DATES = (
    r"\[(\d{1,2})[./\-](\d{1,2})[./\-](\d{2,4})\]",
    r"\((\d{1,2})[./\-](\d{1,2})[./\-](\d{2,4})\)",
    r"(\d{2})[.\-](\d{2})[.\-](\d{4})$",
)
PART_DIGITS = r"(?:part|pt\.?|p)\s*(\d+)\s*$"
PART_ROMAN = r"(?:part|pt\.?)\s+(i{1,3}|iv|vi{0,3}|v|ix|x)\s*$"
PART_FRACTION = r"(\d{1,2})\s*/\s*(\d{1,2})\s*$"
DATE_FRACTION = r"\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{2,4}\s*$"
