"""What people read: digests, traces and the watchdog."""
