"""Query plans and what running them needs."""
