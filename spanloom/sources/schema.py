"""Types of input documents and of sentences, and the corpus configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEYS = ["doc_id", "sentence_id", "sentence_idx"]
REQUIRED = ["doc_id", "sentence_id", "sentence_length", "word"]
FIELD_TYPES = {"string", "text", "u64", "bytes", "edge_positions"}

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("$type" if k == "type" else k, v) for k, v in fields.items()])


_STRINGS = T.ArrayType(T.StringType())
_FIELD = _struct(name=T.StringType(), type=T.StringType(), tokens=_STRINGS, edges=T.ArrayType(_STRINGS), roots=T.ArrayType(T.IntegerType()))
_SENTENCE = _struct(numTokens=T.IntegerType(), fields=T.ArrayType(_FIELD))
_METADATA = _struct(name=T.StringType(), type=T.StringType(), tokens=_STRINGS)
#: A document as it stands in JSON. Edges mix numbers and a label, so all three parts are read as text.
DOCUMENT = _struct(id=T.StringType(), metadata=T.ArrayType(_METADATA), sentences=T.ArrayType(_SENTENCE))
DEPS = "array<struct<src:int,dst:int,label:string>>"


class SchemaError(ValueError):
    """A corpus or configuration that lacks something."""


@dataclass
class SchemaConfig:
    """Layers of a corpus and the fields that queries return."""

    layers: list[str] = field(default_factory=lambda: ["word", "lemma", "pos", "tag", "chunk", "entity", "norm", "raw"])
    output_fields: list[str] = field(default_factory=lambda: ["word", "lemma", "pos", "entity"])

    @classmethod
    def from_dict(cls, config: dict) -> SchemaConfig:
        """From ``{output_fields, fields: [{name, type, stored}]}``; an unknown type is an error."""
        layers = []
        for f in config.get("fields", []):
            if f.get("type") not in FIELD_TYPES:
                raise SchemaError(f"unknown field type {f.get('type')!r} of {f.get('name')!r}")
            if f["type"] == "string":
                layers.append(f["name"])
        if "word" not in layers:
            raise SchemaError("the schema lacks the layer word")
        return cls(layers, config.get("output_fields") or ["word", "lemma", "pos", "entity"])

    @classmethod
    def from_yaml(cls, text: str) -> SchemaConfig:
        """From YAML of that shape: top-level keys, lists of scalars, and a list of flat maps."""
        top: dict = {}
        key, item = None, None
        for raw in text.splitlines():
            line = raw.split("#", 1)[0].rstrip() if raw.lstrip().startswith("#") or " #" in raw else raw.rstrip()
            if not line.strip():
                continue
            bare = line.strip()
            if not line.startswith((" ", "-")):
                name, _, rest = bare.partition(":")
                key, item = name, None
                rest = rest.strip()
                top[key] = [_scalar(x) for x in rest.strip("[]").split(",") if x.strip()] if rest.startswith("[") else _scalar(rest) if rest else []
            elif bare.startswith("- "):
                entry = bare[2:].strip()
                if ":" in entry and not entry.startswith(('"', "'")):
                    name, _, rest = entry.partition(":")
                    item = {name.strip(): _scalar(rest)}
                    top[key].append(item)
                else:
                    top[key].append(_scalar(entry))
            elif item is not None:
                name, _, rest = bare.partition(":")
                item[name.strip()] = _scalar(rest)
        return cls.from_dict(top)


def _scalar(text: str):
    text = text.strip().strip("\"'")
    return {"true": True, "false": False}.get(text, text)


def token_layers(sentences: DataFrame) -> list[str]:
    """Columns that hold one string a token."""
    return [f.name for f in sentences.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)]


def validate_schema(sentences: DataFrame) -> None:
    if lacking := [c for c in REQUIRED if c not in sentences.columns]:
        raise SchemaError(f"required fields are missing: {', '.join(lacking)}")
