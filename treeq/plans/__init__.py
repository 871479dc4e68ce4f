"""From query syntax trees to DataFrame plans."""
