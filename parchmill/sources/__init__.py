"""Readers and writers: parser registry, TEI, checkpoints, glossaries, assets, exports."""
