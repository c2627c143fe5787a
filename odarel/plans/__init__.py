"""From option texts to syntax trees."""
