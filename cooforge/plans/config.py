"""Settings of the solver, what it reports, and parameter files."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace

FACTORS = ("llt", "ldlt", "ldlh", "lu")
REFINEMENTS = ("gmres", "cg", "pivot", "bicgstab")
#: Which refinement goes with which factorisation.
LEGAL = {"gmres": {"lu", "llt", "ldlt", "ldlh"}, "cg": {"llt", "ldlt", "ldlh"}, "pivot": {"lu"}, "bicgstab": {"lu"}}


@dataclass(frozen=True)
class SolverConfig:
    factor: str = "lu"
    refinement: str = "gmres"
    ordering: str = "rcm"
    max_iterations: int = 250
    epsilon: float = 1e-12
    pivot_epsilon: float = 1e-31
    krylov_space: int = 25
    block: int = 64
    checkpoint_every: int = 4
    repair: bool = True
    refine_only: bool = False
    fill_level: int | None = None

    def checked(self, symmetry: str = "general", complex_values: bool = False) -> SolverConfig:
        """Itself, if its parts go together."""
        if self.factor not in FACTORS or self.refinement not in REFINEMENTS:
            raise ValueError("unknown factorisation or refinement")
        if self.factor not in LEGAL[self.refinement]:
            raise ValueError(f"{self.refinement} does not go with {self.factor}")
        if symmetry == "general" and self.factor != "lu":
            raise ValueError("an unsymmetric matrix needs lu")
        if self.factor == "ldlh" and not complex_values:
            raise ValueError("ldlh is for complex values")
        if self.max_iterations < 1 or self.krylov_space < 1 or self.epsilon <= 0:
            raise ValueError("iterations, Krylov space and epsilon must be positive")
        if self.fill_level is not None and (self.fill_level < 0 or not self.refine_only):
            raise ValueError("a level of fill is from 0 on and goes with refine_only, as the exact factor has none")
        return self

    def dump(self) -> str:
        return "".join(f"{k} = {v}\n" for k, v in asdict(self).items())


@dataclass
class SolveStats:
    iterations: int = 0
    relative_error: float | None = None
    replaced_pivots: int = 0
    history: list[tuple[int, float]] = field(default_factory=list)


def load_config(lines, base: SolverConfig | None = None) -> SolverConfig:
    """``name = value`` lines over ``base``; blank lines and those that start with # are skipped."""
    base, kinds, found = base or SolverConfig(), {f.name: f.type for f in fields(SolverConfig)}, {}
    for line in lines:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        name, _, value = (x.strip() for x in line.partition("="))
        if name not in kinds:
            raise ValueError(f"unknown setting {name}")
        if value == "None":
            found[name] = None
        elif kinds[name] == "bool":
            found[name] = value.lower() in ("1", "true", "yes")
        else:
            found[name] = int(value) if kinds[name].startswith("int") else float(value) if kinds[name] == "float" else value
    return replace(base, **found)
