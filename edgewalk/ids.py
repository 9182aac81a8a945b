"""Fixed values that all parts share: splits, stages, reserved tokens."""

from __future__ import annotations

TRAIN, MASK, VAL, TEST, BAD = 0, 1, 2, 3, -1
SPLITS = ("train", "mask", "val", "test")
#: The split whose edges a stage predicts.
STAGE_TARGETS = {"train": MASK, "val": VAL, "test": TEST}

PAD_TOKEN, MASK_TOKEN, UNK_TOKEN, UNK_LABEL = "<PAD>", "<MASK>", "<UNK>", "<UNK_LABEL>"
RESERVED = (PAD_TOKEN, MASK_TOKEN, UNK_TOKEN)
PAD_ID, MASK_ID, UNK_ID = 0, 1, 2
NODE_PREFIX, EDGE_PREFIX = "N_", "E_"
IGNORED = -1
