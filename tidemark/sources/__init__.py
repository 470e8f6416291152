"""File sets, pastes and their lines."""
