"""Part of quarrymill; see the module docstrings."""
