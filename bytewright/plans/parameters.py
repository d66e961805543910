"""Archive parameters and their validation."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.scalars import CODERS, MODELS
from ..operators.codec import REGISTRY

#: Coders that exist: plain, range (three names of one coder), bitwise.
RANGE_CODERS = ("ARI", "ARI32", "ARI64")
BIT_CODER = "ARIFPAQ"


@dataclass(frozen=True)
class Parameters:
    """``block_mode`` transforms blocks before coding; without it a file is coded as it is, in one piece."""

    model: str = "O2"
    coder: str = "ARI"
    block_size: int = 65536
    block_mode: bool = True
    #: Start the model anew with every block: all blocks are coded in parallel, at some cost in size.
    independent_blocks: bool = False

    def __post_init__(self) -> None:
        if self.model not in MODELS or self.coder not in CODERS:
            raise ValueError(f"unknown model or coder: {self.model}, {self.coder}")
        if self.model not in REGISTRY:
            raise ValueError(f"model {self.model} only estimates; nothing could decode it")
        if (self.coder == BIT_CODER) != (self.model == "O1FPAQ"):
            raise ValueError("the bit coder ARIFPAQ and the bit model O1FPAQ go together only")
        if self.coder not in RANGE_CODERS and self.coder != BIT_CODER:
            raise ValueError(f"coder {self.coder} is a name without a coder")
        if self.block_mode and self.model == "O0FIX":
            raise ValueError("O0FIX needs its counts beforehand and works in stream mode only")
        if not 1000 <= self.block_size <= 300_000_000:
            raise ValueError("blocks have 1000 to 300000000 bytes")
