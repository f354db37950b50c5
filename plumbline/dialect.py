"""The few functions in which Spark SQL and the SQL that checks its results are written differently."""

from __future__ import annotations

import re
import unicodedata


def _spelled(letters: str) -> str:
    """Letters as a literal, quotes among them by number."""
    parts = ["chr(39)" if p == "'" else f"'{p}'" for p in re.split("(')", letters) if p]
    return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"


class Spark:
    def text(self, value: str) -> str:
        return "r'" + value + "'" if "\\" in value else "'" + value.replace("'", "\\'") + "'"

    def has(self, column: str, regex: str) -> str:
        return f"regexp_like({column}, {self.text(regex)})"

    def count(self, column: str, regex: str) -> str:
        return f"regexp_count({column}, {self.text(regex)})"

    def letters(self, column: str, one: str) -> str:
        """How many characters are of a class: by what is left without them, since every match costs."""
        return f"length({column}) - length(regexp_replace({column}, {self.text(one + '+')}, ''))"

    def distinct(self, column: str, regex: str) -> str:
        return f"size(array_distinct(regexp_extract_all({column}, {self.text(regex)}, 0)))"

    def every(self, column: str, regex: str, group: int = 0) -> str:
        return f"regexp_extract_all({column}, {self.text(regex)}, {group})"

    def extract(self, column: str, regex: str, group: int = 0) -> str:
        return f"regexp_extract({column}, {self.text(regex)}, {group})"

    def replace(self, column: str, regex: str, by: str = " ") -> str:
        if re.fullmatch("[A-Za-z0-9 :/]+", regex) and not set(by) & set("$\\"):  # no pattern: bytes are compared
            return f"replace({column}, '{regex}', '{by}')"
        return f"regexp_replace({column}, {self.text(regex)}, '{by}')"

    def swapped(self, column: str, letters: str, by: str) -> str:
        """Letters for letters, none of which stands for another one.  Bytes are compared, which costs a tenth of a
        pattern of one letter; Spark's translate looks every character of a text up in a map."""
        for a, b in zip(letters, by):
            column = f"replace({column}, {_spelled(a)}, {_spelled(b)})"
        return column

    def phrases(self, values, inflected: bool = True) -> str:
        """As ``phrases``, its alternatives by first letter: those of one letter stay in their order, and those of
        different letters never match at the same place."""
        by_letter: dict[str, list[str]] = {}
        for v in values:
            one = _phrase(v, inflected)
            by_letter.setdefault(one[0], []).append(one)
        if not by_letter or not all(a.isalnum() for a in by_letter):
            return phrases(values, inflected)
        return "\\b" + lettered({a: f"(?={a})(?:{'|'.join(own)})" for a, own in by_letter.items()}) + "\\b"

    def ref(self, group: int) -> str:
        """A group in a replacement."""
        return f"${group}"

    def pieces(self, column: str, regex: str) -> str:
        return f"split({column}, {self.text(regex)})"

    def kept(self, array: str, name: str, condition: str) -> str:
        return f"filter({array}, {name} -> {condition})"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, '{by}')"

    def array(self, values) -> str:
        return "array(" + ", ".join(self.text(v) if isinstance(v, str) else str(v) for v in values) + ")"

    def at(self, array: str, index: str) -> str:
        """From 0; null beyond the end."""
        return f"get({array}, CAST({index} AS INT))"

    def size(self, array: str) -> str:
        return f"size({array})"

    def contains(self, array: str, value: str) -> str:
        return f"array_contains({array}, {value})"

    def whole(self, expression: str) -> str:
        return f"CAST({expression} AS INT)"

    def once(self, expression: str) -> str:
        """Computed where it stands: the row number, never below 0, keeps the optimizer from copying
        the expression into filters below, where conditions over conditions would multiply."""
        return f"CASE WHEN monotonically_increasing_id() >= 0 THEN {expression} END"


class Duck(Spark):
    def once(self, expression: str) -> str:
        return expression

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def has(self, column: str, regex: str) -> str:
        return f"regexp_matches({column}, {self.text(regex)})"

    def count(self, column: str, regex: str) -> str:
        return f"len(regexp_extract_all({column}, {self.text(regex)}))"

    def letters(self, column: str, one: str) -> str:
        return self.count(column, one)

    def distinct(self, column: str, regex: str) -> str:
        return f"len(list_distinct(regexp_extract_all({column}, {self.text(regex)})))"

    def replace(self, column: str, regex: str, by: str = " ") -> str:
        return f"regexp_replace({column}, {self.text(regex)}, '{by}', 'g')"

    def phrases(self, values, inflected: bool = True) -> str:
        return phrases(values, inflected)

    def swapped(self, column: str, letters: str, by: str) -> str:
        return f"translate({column}, {_spelled(letters)}, {_spelled(by)})"

    def ref(self, group: int) -> str:
        return f"\\{group}"

    def pieces(self, column: str, regex: str) -> str:
        return f"regexp_split_to_array({column}, {self.text(regex)})"

    def kept(self, array: str, name: str, condition: str) -> str:
        return f"list_filter({array}, lambda {name}: {condition})"

    def join(self, array: str, by: str) -> str:
        return f"array_to_string({array}, '{by}')"

    def array(self, values) -> str:
        return "[" + ", ".join(self.text(v) if isinstance(v, str) else str(v) for v in values) + "]"

    def at(self, array: str, index: str) -> str:
        return f"({array})[CAST({index} AS INT) + 1]"

    def size(self, array: str) -> str:
        return f"len({array})"

    def contains(self, array: str, value: str) -> str:
        return f"list_contains({array}, {value})"


SPARK, DUCK = Spark(), Duck()


def _folds() -> tuple[str, str]:
    """Latin letters with marks and the plain letters that they decompose into."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if b != a and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _folds()
INVISIBLE = "[\\x{00AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}\\x{0300}-\\x{036F}]"


def folded(d: Spark, column: str) -> str:
    """Lower case without accents, combining marks and invisible characters."""
    return f"lower(translate({d.replace(column, INVISIBLE, '')}, '{MARKED}', '{PLAIN}'))"


def _phrase(v: str, inflected: bool) -> str:
    words = ["".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in w) for w in v.split()]
    return "\\s+".join(words) + ("(?:s|es|d|ed|ing)?" if inflected and len(v.split()[-1]) > 4 else "")


def phrases(values, inflected: bool = True) -> str:
    """One pattern for a list of words and phrases as whole words; long last words may be inflected."""
    return "\\b(?:" + "|".join(_phrase(v, inflected) for v in values) + ")\\b" if values else "\\b\\B"


def lettered(patterns: dict[str, str], most: int = 4) -> str:
    """Patterns by the letter that each begins with as one: at a place of a text only those of a quarter of the letters
    are tried, of these a quarter again, and none where no pattern begins."""
    letters = sorted(patterns)
    if len(letters) <= most:
        tried = [patterns[a] for a in letters]
    else:
        width = -(-len(letters) // most)
        tried = [lettered({a: patterns[a] for a in letters[i : i + width]}, most) for i in range(0, len(letters), width)]
    return f"(?=[{''.join(letters)}])(?:{'|'.join(tried)})"
