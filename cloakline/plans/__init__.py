"""Plans: options, presets and whole-document dataflows."""
