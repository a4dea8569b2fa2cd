"""Fields of an index, and errors."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class InvalidArgumentError(ValueError):
    """Bad input: a missing or repeated id, a bad schema, no segments to merge."""


class CorruptIndexError(RuntimeError):
    """An index folder that lacks what its manifest names."""


class FieldType(Enum):
    TEXT = "TEXT"
    KEYWORD = "KEYWORD"


@dataclass(frozen=True)
class FieldSchema:
    name: str
    type: FieldType
    stored: bool = False
    indexed: bool = False


class Schema:
    """Declared fields in order. KEYWORD fields are only ever stored, whatever ``indexed`` says."""

    def __init__(self, *fields: FieldSchema):
        self.fields: list[FieldSchema] = []
        self._at: dict[str, int] = {}
        for f in fields:
            self.add_field(f.name, f.type, stored=f.stored, indexed=f.indexed)

    def add_field(self, name: str, type: FieldType, *, stored: bool = False, indexed: bool = False) -> Schema:
        if not name or name in self._at:
            raise InvalidArgumentError(f"field name {name!r} is empty or taken")
        self._at[name] = len(self.fields)
        self.fields.append(FieldSchema(name, type, stored, indexed))
        return self

    def text(self, name: str, *, stored: bool = False, indexed: bool = True) -> Schema:
        return self.add_field(name, FieldType.TEXT, stored=stored, indexed=indexed)

    def keyword(self, name: str, *, stored: bool = True) -> Schema:
        return self.add_field(name, FieldType.KEYWORD, stored=stored)

    def field(self, name: str) -> FieldSchema | None:
        return self.fields[self._at[name]] if name in self._at else None

    def field_index(self, name: str) -> int | None:
        return self._at.get(name)

    @property
    def stored_fields(self) -> list[str]:
        return [f.name for f in self.fields if f.stored]

    @property
    def text_fields(self) -> list[str]:
        return [f.name for f in self.fields if f.indexed and f.type is FieldType.TEXT]

    @property
    def stored_field_count(self) -> int:
        return len(self.stored_fields)

    @property
    def indexed_field_count(self) -> int:
        return len(self.text_fields)

    def to_json(self) -> list[dict]:
        return [{"name": f.name, "type": f.type.value, "stored": f.stored, "indexed": f.indexed} for f in self.fields]

    @classmethod
    def from_json(cls, fields: list[dict]) -> Schema:
        return cls(*[FieldSchema(f["name"], FieldType(f["type"]), f["stored"], f["indexed"]) for f in fields])
