"""What may be shown or stored: masked and sealed keys, redacted parameters, problems of fields, records without a nested field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the name of a parameter that isn't logged contains, the length a logged value is cut to, characters of a key that are shown.
SENSITIVE, LOGGED, VISIBLE = "key|url|token", 100, 4


def masked(key: Column, visible: int = VISIBLE) -> Column:
    """A key with stars for all but its last characters, all of them where it is that short; null for an empty one."""
    n = F.length(key)
    hidden = F.when(n > visible, n - visible).otherwise(n)
    return F.when(n > 0, F.concat(F.repeat(F.lit("*"), hidden), F.when(n > visible, F.substr(key, n - visible + 1)).otherwise("")))


def sealed(key: Column, master: Column) -> Column:
    """A key under AES-GCM as base64; master is 16, 24 or 32 bytes and best read from a table, so that plans don't show it. Each call seals anew."""
    return F.base64(F.aes_encrypt(key.cast("binary"), master, F.lit("GCM")))


def unsealed(text: Column, master: Column) -> Column:
    """The key that sealed made text of, null where text is damaged or of another master."""
    return F.try_aes_decrypt(F.unbase64(text), master, F.lit("GCM")).cast("string")


def logged(params: Column) -> Column:
    """Parameters (a map of strings) as `name=value, ...` by name: without those whose names are sensitive, values cut."""
    kept = F.map_filter(params, lambda k, v: ~F.lower(k).rlike(SENSITIVE))
    names = F.array_sort(F.map_keys(kept))
    return F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), F.coalesce(F.left(F.try_element_at(kept, k), F.lit(LOGGED)), F.lit("")))), ", ")


@dataclass(frozen=True)
class Rule:
    """What a field must be. Blank texts count as empty; only given fields have a length or are compared with the allowed ones."""

    field: str
    required: bool = False
    longest: int | None = None
    allowed: tuple[str, ...] = ()
    pattern: str | None = None

    def problem(self) -> Column:
        text = F.trim(F.coalesce(F.col(self.field).cast("string"), F.lit("")))
        out = F.when(F.lit(self.required) & (text == ""), f"{self.field} is empty")
        given = F.col(self.field).cast("string")
        if self.longest is not None:
            out = out.when(F.length(given) > self.longest, f"{self.field} is longer than {self.longest}")
        if self.allowed:
            out = out.when((text != "") & ~given.isin(*self.allowed), f"{self.field} is none of {', '.join(self.allowed)}")
        if self.pattern:
            out = out.when((text != "") & ~given.rlike(self.pattern), f"{self.field} has a wrong form")
        return out


def problems(rules: list[Rule], one_of: tuple[str, ...] = ()) -> Column:
    """The problems of a row by rules, a field's first each, in the order of the rules; of one_of at least one must be given."""
    found = [r.problem() for r in rules]
    if one_of:
        empty = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in one_of]
        all_empty = empty[0]
        for e in empty[1:]:
            all_empty = all_empty & e
        found.append(F.when(all_empty, f"one of {', '.join(one_of)} must be given"))
    return F.array_compact(F.array(*found))


def without_field(items: Column, *names: str) -> Column:
    """A list of structs without some of their fields."""
    return F.transform(items, lambda x: x.dropFields(*names))
