"""Typed settings of a corpus job, and their properties files.

A properties file has `key = value` lines; a key may carry a namespace, and then counts only if the namespace starts
with the one asked for. Relative folders are resolved against data_dir, and that against home_dir, once.
Divergence: the list of annotators belongs to the settings it was given to and doesn't accumulate.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    home_dir: str = "."
    data_dir: str = "data"
    index_dir: str = "index"
    input_dir: str = "input"
    output_dir: str = "output"
    tables_dir: str = "tables"
    cooc_file: str = "cooc.bin"
    posc_file: str = "posc.dsv"
    freq_file: str = "freq.dsv"
    lxcn_file: str = "lxcn.dsv"
    term_id: str = "_term_"
    reader: str = "parquet"
    writer: str = "parquet"
    annotators: tuple[str, ...] = ()
    consumer: str = "index"
    on_error: str = "continue"
    doc_id: str = "doc_id"
    field_txt: str = "text_field"
    field_split: str | None = "split_field"
    field_filter: str = "filter_field"
    filter_term: str = ""
    cooc_w_pre: int = 10
    cooc_w_pos: int = 10
    min_term_freq: int = 5
    threads: int = 0  # tasks at a time that small inputs are dealt for; 0: as many as the cluster has cores
    quiet: bool = False
    dump_conf: bool = False
    others: tuple[tuple[str, str], ...] = ()

    def get_list(self, key: str, factory=str) -> list:
        """A setting of parts that these settings don't name: its elements, parted by commas, each made by the factory."""
        return [factory(x.strip()) for x in dict(self.others).get(key, "").split(",") if x.strip()]

    def get_map(self, key: str, factory=str) -> dict:
        """As get_list, of elements `name:value`."""
        return {k.strip(): factory(v.strip()) for k, _, v in (x.partition(":") for x in self.get_list(key))}

    def get_other(self, key: str, factory=str, default=None):
        value = dict(self.others).get(key)
        return default if value is None else factory(value)

    def folder(self, name: str) -> str:
        """The absolute path of index_dir, input_dir, output_dir or tables_dir."""
        return os.path.join(os.path.abspath(self.home_dir), self.data_dir, getattr(self, name))

    def with_values(self, values: dict[str, str]) -> Settings:
        """Settings with these values. A key with a dot, `part.parameter`, belongs to a reader, annotator or consumer and is
        kept for it; any other key that isn't a setting is an error."""
        kinds = {f.name: f.type for f in fields(self)}
        unknown = {k for k in values if k not in kinds and "." not in k}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        others = {**dict(self.others), **{k: v for k, v in values.items() if k not in kinds}}
        return replace(self, **{k: _decoded(v, kinds[k]) for k, v in values.items() if k in kinds}, others=tuple(sorted(others.items())))

    def parameters(self, part: str) -> dict[str, str]:
        """The parameters `part.parameter` of a part."""
        return {k[len(part) + 1 :]: v for k, v in self.others if k.startswith(part + ".")}


def _decoded(value, kind: str):
    if not isinstance(value, str):
        return value
    if kind == "int":
        return int(value)
    if kind == "bool":
        return value.strip().lower() in ("true", "1", "yes")
    if kind.startswith("tuple"):
        return tuple(x.strip() for x in value.split(",") if x.strip())
    return value


def read_properties(path: str, namespace: str = "") -> dict[str, str]:
    found = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            line = line.strip()
            if not line or line[0] in "#!":
                continue
            key, _, value = line.partition("=")
            prefix, _, name = key.strip().rpartition(".")
            if not prefix or prefix.startswith(namespace):
                found[name] = value.strip()
    return found


def load(conf_dir: str = "conf", base: str = "base.properties", namespace: str = "", home: str = ".") -> Settings:
    path = os.path.join(conf_dir, base)
    values = read_properties(path, namespace) if os.path.exists(path) else {}
    return Settings(home_dir=home).with_values(values)
