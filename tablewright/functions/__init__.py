"""Column-level building blocks: type kinds, specs, prompts, rules."""
