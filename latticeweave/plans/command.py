"""Typed options of a command line: --name=value, --name value, -n value; flags without a value; everything after -- is an argument."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


class CommandLineError(ValueError):
    """An option that isn't known, that lacks its value, or whose value is of another type."""


def _flag(text: str) -> bool:
    values = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}
    if text.lower() not in values:
        raise ValueError(text)
    return values[text.lower()]


def _char(text: str) -> str:
    if len(text) != 1:
        raise ValueError(text)
    return text


#: Types of values by name.
TYPES: dict[str, Callable[[str], object]] = {"bool": _flag, "int": int, "float": float, "str": str, "char": _char}


@dataclass(frozen=True)
class Option:
    name: str
    short: str
    kind: str
    help: str


class Command:
    """Options are added one by one; parse() gives their values and the arguments that are left."""

    def __init__(self, description: str = "", help_option: bool = True):
        self.description, self.options = description, {}
        if help_option:
            self.add("help", "h", "bool", "Show this text")

    def add(self, name: str, short: str, kind: str, help: str = "") -> Command:
        if kind not in TYPES or len(short) > 1 or name in self.options or (short and any(o.short == short for o in self.options.values())):
            raise ValueError(f"option {name} ({short}) of type {kind} can't be added")
        self.options[name] = Option(name, short, kind, help)
        return self

    def _named(self, word: str) -> Option:
        long = word.startswith("--")
        for o in self.options.values():
            if word == (f"--{o.name}" if long else f"-{o.short}"):
                return o
        raise CommandLineError(f"unknown option {word}")

    def parse(self, words: list[str]) -> tuple[dict[str, object], list[str]]:
        values, rest, k = {}, [], 0
        while k < len(words):
            word, k = words[k], k + 1
            if word == "--":
                rest += words[k:]
                break
            if not word.startswith("-") or word == "-":
                rest.append(word)
                continue
            name, given, value = word.partition("=")
            option = self._named(name)
            if not given and option.kind == "bool":
                value = "true"
            elif not given:
                if k == len(words):
                    raise CommandLineError(f"option {name} needs a value")
                value, k = words[k], k + 1
            try:
                values[option.name] = TYPES[option.kind](value)
            except ValueError:
                raise CommandLineError(f"{value!r} is no {option.kind} for option {name}") from None
        return values, rest

    def usage(self) -> str:
        rows = [((f"-{o.short}, " if o.short else "    ") + f"--{o.name}" + ("" if o.kind == "bool" else f" <{o.kind}>"), o.help) for o in self.options.values()]
        width = max(len(a) for a, _ in rows) if rows else 0
        return "\n".join([self.description, *(f"  {a:<{width}}  {b}" for a, b in rows)]) + "\n"
