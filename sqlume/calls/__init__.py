"""Model calls: providers, memo, budget, batching."""
