"""Settings and fixed tables of the domain."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Canonical classes and ids, grey values of masks, spellings of class names, grey values by spelling in
# the inference tiler, colours of grey values.
CLASS_IDS = {"background": 0, "No_Proliferativo": 1, "Proliferativo": 2, "Esclerosado": 3, "Excluido": 4}
CLASS_GRAYS = {"background": 0, "No_Proliferativo": 64, "Proliferativo": 128, "Esclerosado": 192, "Excluido": 255}
CLASS_SPELLINGS = {
    "noprolif": "No_Proliferativo",
    "noproliferativo": "No_Proliferativo",
    "no_proliferativo": "No_Proliferativo",
    "proliferativo": "Proliferativo",
    "prolif": "Proliferativo",
    "esclerosado": "Esclerosado",
    "sclerosed": "Esclerosado",
    "sclerotic": "Esclerosado",
    "exclude": "Excluido",
    "excluido": "Excluido",
    "excluyente": "Excluido",
    "excluded": "Excluido",
}
INFERENCE_GRAYS = {"no prolif": 64, "no_proliferativo": 64, "prolif": 128, "proliferativo": 128, "esclerosado": 192, "exclude": 255, "excluido": 255, "excluded": 255}
INFERENCE_GRAY_DEFAULT = 64
GRAY_COLORS = {0: (0, 0, 0), 64: (0, 255, 0), 128: (255, 0, 0), 192: (255, 165, 0), 255: (128, 0, 128)}
LARGE_FILE_BYTES = 300 * 1024 * 1024
COLOR_MEANS = (0.485, 0.456, 0.406)
COLOR_STDS = (0.229, 0.224, 0.225)


@dataclass(frozen=True)
class TilingConfig:
    """Tiling settings; from_layers() merges a config file's values and command-line ones over these defaults."""

    tile_size: int = 1024
    zoom_scale: float = 0.5
    stride: int = 1024
    overlap: int = 256
    min_coverage_pct: float = 60.0
    output_format: str = "png"
    compression: int = 0
    otsu_min_ratio: float = 0.01
    bg_threshold: float = 15.0
    downsample_factor: int = 20

    @property
    def native_tile(self) -> int:
        return int(self.tile_size / self.zoom_scale)

    @property
    def native_stride(self) -> int:
        return int(self.stride / self.zoom_scale)

    @property
    def inference_stride(self) -> int:
        return int((self.tile_size - self.overlap) / self.zoom_scale)

    @classmethod
    def from_layers(cls, *layers: dict | None) -> TilingConfig:
        """Later layers win; None values, unknown keys and the nesting of tissue_filter are smoothed out."""
        names, got = {f.name for f in fields(cls)}, {}
        for layer in layers:
            flat = {**(layer or {}), **((layer or {}).get("tissue_filter") or {})}
            got |= {k: v for k, v in flat.items() if k in names and v is not None}
        return cls(**got)

    @classmethod
    def from_yaml(cls, path: str, **command_line) -> TilingConfig:
        """Settings of a YAML file; a missing file means the defaults."""
        try:
            import yaml

            with open(path) as f:
                loaded = yaml.safe_load(f)
        except FileNotFoundError:
            loaded = None
        return cls.from_layers(loaded, command_line)
