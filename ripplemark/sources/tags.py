"""Chunk tags: their spellings, and the member types whose content they hold."""

from __future__ import annotations

from functools import lru_cache

#: Canonical tag by spelling; a spelling may also be stored reversed.
_SPELLINGS = {
    "KEY*": "YEK* KEY", "CASt": "CAS* cas* CArT CAsT cast CAS2", "CLUT": "clut Palt palt PALT", "BITD": "bitd DIB DIB*",
    "STXT": "stxt TXTS", "snd": "SND SND*", "medi": "", "MCsL": "Lscl abmc", "LctX": "LCTX Lctx lctx XTCL", "Lnam": "", "Lscr": "LSCR",
    "imap": "IMAP", "mmap": "MMAP", "Abmp": "ABMP", "Fver": "", "Fmap": "", "Fcdr": "", "FGEI": "", "ILS": "", "DRCF": "VWCF", "VWSC": "", "Score": "SCORE",
    "ALFA": "", "TEXT": "text", "SHAP": "", "XTRA": "", "VWFT": "", "FONT": "", "VCSH": "", "Flas": "", "MooV": "", "VdM": "", "PICT": "", "PIXL": "", "ILBM": "", "MCrs": "", "Thum": "",
    "FGDC": "", "FGDM": "",
}
ALIASES = {s: canon for canon, others in _SPELLINGS.items() for s in (canon, *others.split())}


@lru_cache(4096)
def canonical(tag: str) -> str:
    """The usual spelling of a tag (blanks at its ends don't count): as it is, else reversed, else unchanged."""
    for t in (tag, tag[::-1]):
        if (found := ALIASES.get(t.strip())) is not None:
            return found
    return tag.strip()


TYPES = {
    0: "Null", 1: "Bitmap", 2: "FilmLoop", 3: "Text", 4: "Palette", 5: "Picture", 6: "Sound", 7: "Button", 8: "Shape", 9: "Movie", 10: "DigitalVideo", 11: "Script", 12: "RTE",
    13: "Field", 14: "Transition", 15: "Xtra", 16: "Font", 17: "Mesh", 18: "VectorShape", 19: "Flash", 53: "Bitmap (Type 53)", 121: "Unknown (Type 121)", 638: "Unknown (Type 638)", 2049: "Unknown (Type 2049)",
}
_TEXT = ("STXT", "TEXT")
#: Content tags of each type, the preferred one first.
CONTENT = {
    1: ("BITD", "Abmp", "PIXL", "ILBM", "MCrs"), 2: ("CASt",), 3: _TEXT, 4: ("CLUT",), 5: ("PICT",), 6: ("snd", "medi"), 7: ("CASt",), 8: ("SHAP", "CASt"), 9: ("CASt",),
    10: ("MooV", "VdM"), 11: ("Lscr",), 13: _TEXT, 14: ("CASt", "Fx"), 15: ("XTRA",), 16: ("FONT", "VWFT"), 18: ("VCSH",), 19: ("Flas",),
}
#: Order in which a type is told from the tags that a member owns.
DETECTION = (1, 4, 3, 11, 6, 15, 8, 16, 10, 19, 5, 18, 14)


def detected(tag: str) -> int | None:
    """The type that a content tag alone tells; the members' own records tell none."""
    if tag.startswith("Fx"):
        return 14
    return next((t for t in DETECTION if tag in CONTENT[t] and tag != "CASt"), None)
