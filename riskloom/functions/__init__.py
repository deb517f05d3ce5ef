"""Pure Column builders, usable in batch and streaming queries alike."""
