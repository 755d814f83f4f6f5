"""siftwork.plans"""
