"""Rules, chains, and signed packs of them."""
