"""Run parameters: text files of ``Name value`` lines, checked and dumped again in the same form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from swarmtide.functions.cosmology import gravity

COMPULSORY = ("SnapshotPath", "HaloPath", "SubhaloPath", "SnapshotFileBase", "MaxSnapshotIndex", "BoxSize", "SofteningHalo")


@dataclass
class EngineConfig:
    """Names and defaults are those of the parameter files that users have."""

    SnapshotPath: str = ""
    HaloPath: str = ""
    SubhaloPath: str = ""
    SnapshotFileBase: str = ""
    MaxSnapshotIndex: int = 0
    BoxSize: float = 0.0
    SofteningHalo: float = 0.0
    SnapshotFormat: str = "gadget"
    GroupFileFormat: str = "gadget3_int"
    MaxConcurrentIO: int = 10
    MinSnapshotIndex: int = 0
    MinNumPartOfSub: int = 20
    GroupParticleIdMask: int = 0
    MassInMsunh: float = 1e10
    LengthInMpch: float = 1.0
    VelInKmS: float = 1.0
    PeriodicBoundaryOn: bool = True
    SnapshotHasIdBlock: bool = True
    ParticleIdRankStyle: bool = False
    ParticleIdNeedHash: bool = True
    SnapshotIdUnsigned: bool = False
    SaveSubParticleProperties: bool = False
    MergeTrappedSubhalos: bool = True
    MajorProgenitorMassRatio: float = 0.8
    BoundMassPrecision: float = 0.995
    SourceSubRelaxFactor: float = 3.0
    SubCoreSizeFactor: float = 0.25
    SubCoreSizeMin: int = 20
    TreeAllocFactor: float = 0.8
    TreeNodeOpenAngle: float = 0.45
    TreeMinNumOfCells: int = 10
    MaxSampleSizeOfPotentialEstimate: int = 1000
    RefineMostboundParticle: bool = True
    SnapshotIdList: list[int] = field(default_factory=list)

    @property
    def gravity(self) -> float:
        return gravity(self.MassInMsunh, self.LengthInMpch, self.VelInKmS)[0]

    @property
    def hubble0(self) -> float:
        return gravity(self.MassInMsunh, self.LengthInMpch, self.VelInKmS)[1]

    @property
    def box(self) -> float | None:
        return self.BoxSize if self.PeriodicBoundaryOn else None

    def snapshot_id(self, index: int) -> int:
        return self.SnapshotIdList[index] if self.SnapshotIdList else index

    def dump(self) -> str:
        """Text that ``parse`` reads back to an equal configuration."""
        lines = []
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "SnapshotIdList" and not value:
                continue
            value = " ".join(map(str, value)) if isinstance(value, list) else hex(value) if f.name == "GroupParticleIdMask" else int(value) if isinstance(value, bool) else value
            lines.append(f"{f.name} {value}")
        return "\n".join(lines) + "\n"


def parse(text: str) -> EngineConfig:
    """Reads parameters; ``#`` and ``[`` start a comment. Raises on unknown names, missing ones, and a list of another length."""
    config, seen = EngineConfig(), set()
    kinds = {f.name: f.type for f in fields(EngineConfig)}
    for line in text.splitlines():
        words = re.split(r"[#\[]", line, maxsplit=1)[0].split()
        if not words:
            continue
        name, *values = words
        if name not in kinds:
            raise ValueError(f"unknown parameter {name}")
        if not values:
            raise ValueError(f"{name} has no value")
        seen.add(name)
        if name == "SnapshotIdList":
            value = list(map(int, values))
        elif name == "GroupParticleIdMask":
            value = int(values[0], 16)
        else:
            value = {"int": int, "float": float, "str": str, "bool": lambda x: bool(int(x))}[kinds[name]](values[0])
        setattr(config, name, value)
    if missing := [n for n in COMPULSORY if n not in seen]:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    if config.SnapshotIdList and config.MaxSnapshotIndex != len(config.SnapshotIdList) - 1:
        raise ValueError("MaxSnapshotIndex does not fit the length of SnapshotIdList")
    if config.ParticleIdRankStyle:
        config.ParticleIdNeedHash = False
    return config
