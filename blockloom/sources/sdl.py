"""Entity schemas in GraphQL's schema language: object types marked @entity become tables.

Lists of any depth are one flag; only the outermost non-null counts; all other directives are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import ConfigError, UnsupportedType
from ..functions.naming import checked_identifier, table_name, underscore

SCALARS = {"ID": T.StringType(), "String": T.StringType(), "Int": T.IntegerType(), "BigInt": T.StringType(), "Float": T.DoubleType(), "Boolean": T.BooleanType(), "Date": T.TimestampNTZType(), "Bytes": T.BinaryType(), "Json": T.VariantType()}

_TOKEN = re.compile(r'"""(?:.|\n)*?"""|"(?:\\.|[^"\\\n])*"|#[^\n]*|[A-Za-z_][A-Za-z0-9_]*|[-+]?[0-9.]+|[{}()\[\]:!@=|&,]|\s+|.')


@dataclass(frozen=True)
class Field:
    name: str
    base: str
    is_list: bool
    nullable: bool

    @property
    def column(self) -> str:
        return checked_identifier(underscore(self.name))

    def spark_type(self) -> T.DataType:
        if self.base not in SCALARS:
            raise UnsupportedType(f"{self.name}: {self.base}")
        return T.ArrayType(SCALARS[self.base]) if self.is_list else SCALARS[self.base]


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Field, ...]

    @property
    def table(self) -> str:
        return checked_identifier(table_name(self.name))

    def struct(self) -> T.StructType:
        """The table's schema; exactly one ``id: ID!`` is needed."""
        if [f.name for f in self.fields if f.base == "ID"] != ["id"] or any(f.name == "id" and (f.nullable or f.is_list) for f in self.fields):
            raise ConfigError(f"{self.name} needs exactly one field id: ID!")
        return T.StructType([T.StructField(f.column, f.spark_type(), f.nullable) for f in self.fields])


class _Reader:
    def __init__(self, text: str):
        self.tokens = [t for t in _TOKEN.findall(text) if not t.isspace() and t[0] not in "#," and t[0] != '"']
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or want is not None and t != want:
            raise ConfigError(f"schema: expected {want or 'more'}, found {t or 'the end'}")
        self.at += 1
        return t

    def skip_block(self, opening: str, closing: str) -> None:
        if self.peek() == opening:
            depth = 0
            while True:
                depth += {opening: 1, closing: -1}.get(self.take(), 0)
                if not depth:
                    return

    def directives(self) -> list[str]:
        out = []
        while self.peek() == "@":
            self.take()
            out.append(self.take())
            self.skip_block("(", ")")
        return out

    def type_of(self) -> tuple[str, bool, bool]:
        """base, list, nullable."""
        if self.peek() == "[":
            self.take()
            base, _, _ = self.type_of()
            self.take("]")
            is_list = True
        else:
            base, is_list = self.take(), False
        required = self.peek() == "!"
        if required:
            self.take()
        return base, is_list, not required


def parse(text: str) -> list[Entity]:
    r, out = _Reader(text), []
    while r.peek():
        if r.take() != "type":
            while r.peek() and r.peek() not in ("type",):
                if r.peek() in "{(":
                    r.skip_block(r.peek(), {"{": "}", "(": ")"}[r.peek()])
                else:
                    r.take()
            continue
        name = r.take()
        while r.peek() and r.peek() not in ("{", "@"):
            r.take()
        marks, fields = r.directives(), []
        r.take("{")
        while r.peek() != "}":
            field = r.take()
            r.skip_block("(", ")")
            r.take(":")
            fields.append(Field(field, *r.type_of()))
            r.directives()
        r.take("}")
        if "entity" in marks:
            out.append(Entity(name, tuple(fields)))
    return out
